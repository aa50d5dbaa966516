import pytest

from embedframe.llm import licenses

NEIGHBOURS = {
    "Released under the BSD License.": ["BSD"],
    "Released under the ISC License.": ["ISC"],
    "Released under the Sleepycat License.": [],
    "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
    "Licensed under CC BY NC 4.0.": ["CC-BY-NC-4.0"],
    "Licensed under the Apache License, Version 1.1.": ["Apache-1.1"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Licensed under the MIT License.": ["MIT"],
    "Released under the MIT No Attribution License.": [],
    "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
    "This work is licensed under the GNU General Public License, version 3.0.": ["GPL-3.0"],
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
    "Licensed under the Mozilla Public License, Version 2.0.": ["MPL-2.0"],
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
    "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"],
    "SPDX-License-Identifier: BSD-3-Clause": ["BSD"],
    "SPDX-License-Identifier: Sleepycat": [],
    "Its SPDX-License-Identifier is not MIT": [],
    "Licensed under the Apache License 2.0": ["Apache-2.0"],
    "Licensed under the Apache License 1.0": [],
    "Released under the Apache 2.0 license": ["Apache-2.0"],
    "Licensed under GPLv3.": ["GPL-3.0"],
    "Licensed under LGPLv3.": ["LGPL-3.0"],
    "Licensed under the GPL v2": ["GPL-2.0"],
    "Licensed under GPL.": [],
    "The MIT License (MIT)": ["MIT"],
    "Boost Software License - Version 1.0": ["BSL-1.0"],
    "Some Other Software License - Version 1.0": [],
    licenses.TEMPLATES["GPL-3.0"][1].replace("version 3", "version 2"): ["GPL-2.0"],
    licenses.TEMPLATES["GPL-3.0"][1].replace("GNU", "GNU Lesser"): ["LGPL-3.0"],
}


@pytest.mark.parametrize("text", NEIGHBOURS)
def test_neighbouring_licenses_are_told_apart(text):
    s = licenses.Scanner(licenses.TEMPLATES)
    assert [m.license for m in s.scan(f"Some words before. {text} Some words after.")] == NEIGHBOURS[text]


def test_each_template_finds_its_license():
    s = licenses.Scanner(licenses.TEMPLATES)
    assert all([(m.license, m.coverage) for m in s.scan(t)] == [(name, 1.0)] for name, ts in licenses.TEMPLATES.items() for t in ts)
