"""Licence notices that the licence scan knows."""

from __future__ import annotations

# --- fixed values: phrases whose places are always reported ---------------
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# --- fixed values: public licence notices, by label and name --------------
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""),
    ("apache", "Apache-2.0 header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", "GPL header", """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
    ("lgpl", "LGPL header", """This library is free software; you can redistribute it and/or modify it under the terms
of the GNU Lesser General Public License as published by the Free Software Foundation"""),
    ("agpl", "AGPL header", """under the terms of the GNU Affero General Public License as published by the Free
Software Foundation"""),
    ("bsd", "BSD conditions", """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("isc", "ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", "MPL-2.0 header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free
to copy, modify, publish, use, compile, sell, or distribute this software"""),
    ("cc-by", "CC BY", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "CC BY short", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "CC BY-SA", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "CC BY-SA short", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "CC BY-NC short", "Licensed under CC BY-NC 4.0"),
    ("cc0", "CC0", "has waived all copyright and related or neighboring rights to this work"),
]
