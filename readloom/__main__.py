import sys

from readloom.plans.cli import main

sys.exit(main())
