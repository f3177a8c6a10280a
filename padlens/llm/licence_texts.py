"""The known licence sentences and the rules over their identifiers."""

# Sentences of public licences and notices, each with its identifier.
SENTENCES = {
    "mit-short": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-title": ["ISC License"],
    "apache-short": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-short": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache-title": ["Apache License"],
    "apache-version": ["Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "gpl2-version": ["Version 2, June 1991"],
    "gpl3-version": ["Version 3, 29 June 2007"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "lgpl21-version": ["Version 2.1, February 1999"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "agpl-version": ["Version 3, 19 November 2007"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "epl2-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc0-short": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "CC0 1.0 Universal"],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-regents": ["Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "mpl-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl-short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
# Licences and the identifier sequences that state them, in order.
RULES = [
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("MPL-2.0", ("mpl-short", "mpl-copy")),
    ("MPL-2.0", ("mpl-short",)),
    ("MPL-2.0", ("mpl-title",)),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-title", "apache-version", "apache-terms")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl-title", "gpl2-version")),
    ("GPL-3.0-only", ("gpl-title", "gpl3-version")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl21-version")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-3.0-only", ("lgpl-title", "gpl3-version")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-only", ("agpl-title", "agpl-version")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("EPL-2.0", ("epl2-short",)),
    ("EPL-2.0", ("epl2-title",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-regents")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-regents")),
    ("0BSD", ("0bsd-grant", "as-is")),
]
#: Each licence's tag in one line, as a sentence and a rule of its own.
TAGGED = sorted({name for name, _ in RULES})
SENTENCES |= {f"spdx-{name}": [f"SPDX-License-Identifier: {name}"] for name in TAGGED}
RULES += [(name, (f"spdx-{name}",)) for name in TAGGED]
