"""Pieces of SQL that queries over reads share; see ``synthetic.MATCHES``."""

from __future__ import annotations

JOINED = " from reads r join s on s.idx = r.idx join a on a.idx = r.idx join b on b.idx = r.idx join c on c.idx = r.idx join d on d.idx = r.idx join p on p.idx = r.idx"
NAME = "regexp_extract(name, '^[^ \t]*', 0)"
HEADER = f"concat({NAME}, chr(9), 'BX:Z:', a.tag, c.tag, b.tag, d.tag, '-', p.tag, chr(9), 'RX:Z:', s2, s3, '+', si, chr(9), 'QX:Z:', q2, q3, '+', qi)"
BARE_HEADER = f"concat({NAME}, chr(9), 'BX:Z:', a.tag, c.tag, b.tag, d.tag, chr(9), 'RX:Z:', s2, s3, chr(9), 'QX:Z:', q2, q3)"
CLIP = "(11 + case a.rt when 'unclear' then 8 when 'invalid' then 0 else length((select code from bc where set_name = 'A' and bc.ord = a.ord)) end)"
CLASS = "case when least(a.ord, b.ord, c.ord, d.ord) = 0 then 'unclear' when greatest(a.ed, b.ed, c.ed, d.ed) > 0 then 'corrected' else 'correct' end"
LOGGED = f"logged as (select concat(a.tag, c.tag, b.tag, d.tag, p.tag) as code, {CLASS} as rt {JOINED})"
