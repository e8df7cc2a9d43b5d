"""Licence templates; of their texts only the words count. Notices of one line as they are
put into documents, the bodies of the short licences, and the whole texts of the long ones (the files in
``licence_texts``). Variants share a name before ``/``."""

from __future__ import annotations

from pathlib import Path

_AS_IS = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
    "software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution "
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the software the software is "
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
    "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"this program is free software you can redistribute it and or modify it under the terms of the {name} as published "
        f"by the free software foundation either version {version} of the license or at your option any later version this "
        "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
        f"of merchantability or fitness for a particular purpose see the {name} for more details"
    )


TEMPLATES: dict[str, str] = {
    "mit/notice": "released under the mit license",
    "mit/licensed": "licensed under the mit license",
    "mit/project": "this project is licensed under the terms of the mit license",
    "mit/body": _MIT,
    "isc/body": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-clause/body": _BSD + _AS_IS,
    "bsd-3-clause/body": _BSD
    + "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission " + _AS_IS,
    "bsd-3-clause/notice": "released under the bsd 3 clause license",
    "apache-2.0/notice": "licensed under the apache license version 2 0",
    "apache-2.0/header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable "
        "law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license"
    ),
    "gpl-2.0/notice": "this work is licensed under the gnu general public license version 2",
    "gpl-3.0/notice": "this work is licensed under the gnu general public license version 3",
    "gpl-2.0/header": _gnu("gnu general public license", "2"),
    "gpl-3.0/header": _gnu("gnu general public license", "3"),
    "lgpl-3.0/header": _gnu("gnu lesser general public license", "3"),
    "agpl-3.0/header": _gnu("gnu affero general public license", "3"),
    "mpl-2.0/header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at https mozilla org mpl 2 0"
    ),
    "cc-by-4.0/notice": "licensed under cc by 4 0",
    "cc-by-sa-4.0/notice": "licensed under cc by sa 4 0",
    "cc-by-nc-4.0/notice": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-4.0/notice": "licensed under cc by nc sa 4 0",
    "cc-by-nd-4.0/notice": "licensed under cc by nd 4 0",
    "cc-by-4.0/long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0/long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4.0/long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-1.0/long": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense/body": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means"
    ),
    "proprietary/notice": "all rights reserved",
}

TEMPLATES |= {f"{p.stem}/text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
