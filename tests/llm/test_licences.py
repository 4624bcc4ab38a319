from tessera.llm import licences as c

GPL = "This work is licensed under the GNU General Public License, version 3."


def test_query(same_as_duckdb):
    same_as_duckdb(c.op5_licences, c.OP5_SQL)


def scan(spark, *rows):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, score double")
    return sorted(((r.path or "", r.own_licence, r.licence, r.inherited_from) for r in c.licence_scan(df).collect()), key=str)


def test_nearest_ancestor(spark):
    got = dict((r[0], r[1:]) for r in scan(
        spark, ("LICENSE", "Released under the MIT License."), ("a/COPYING.txt", GPL), ("a/b/c/x.py", "code"), ("a/y.py", "text\n// " + GPL.replace("3", "2") + "\nmore"),
        ("z.py", ""), ("b/none.py", None), ("b/LICENSE.md", "nothing of the kind"), ("d/e.py", "# All rights reserved."),
    ))
    assert got["a/b/c/x.py"] == (None, "GPL-3.0", "a") and got["a/y.py"] == ("GPL-2.0", "GPL-2.0", None)
    assert got["z.py"] == (None, "MIT", "") or got["z.py"][1] is None
    assert got["LICENSE"][0] == "MIT" and got["b/LICENSE.md"][0] is None and got["d/e.py"] == ("Proprietary", "Proprietary", None)


def test_scores_are_cosines(spark):
    df = spark.createDataFrame([("x", GPL), ("y", "licensed under something else entirely, sir")], "path string, text string")
    rows = {r.path: r for r in c.licence_scan(df).collect()}
    assert rows["x"].own_licence == "GPL-3.0" and abs(rows["x"].score - 1) < 1e-6 and rows["y"].own_licence is None and rows["y"].score is None


def test_odd_rows(spark):
    assert scan(spark) == []
    got = scan(spark, (None, GPL), ("x.py", GPL), ("x.py", GPL), ("y.py", ("text " * 50_000) + "\n" + GPL), ("same/p", "All rights reserved.\nReleased under the MIT License. " + GPL), ("q", ""))
    assert len(got) == 6 and [r[1] for r in got if r[0] == "x.py"] == ["GPL-3.0"] * 2 and next(r for r in got if r[0] == "y.py")[1] == "GPL-3.0"
    assert next(r for r in got if r[0] == "q")[1:] == (None, None, None)


def test_ordinary_licence_files(spark):
    bsd = "Copyright (c) 2020, Some One. All rights reserved.\n\n" + "\n\n".join(
        (
            "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
            "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
            "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
        )
    )
    gpl3 = (
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
        "                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.\n"
    )
    header = "\n".join(f"# {x}" for x in ("This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version {} of the License, or", "(at your option) any later version."))
    apache = "/*\n * Copyright 2021 Some One\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */\nint x;\n"
    isc = "ISC License\n\nCopyright (c) 2019 Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    mit = "MIT License\n\nCopyright (c) 2022 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n"
    found = {path: own for path, own, _, _ in scan(
        spark, ("b/LICENSE", bsd), ("g/COPYING", gpl3), ("h/three.py", header.format(3) + "\n\nx = 1\n"), ("h/two.py", header.format(2) + "\n\nx = 1\n"), ("i/LICENSE", isc), ("m/LICENSE", mit), ("a/x.c", apache),
        ("s/a.py", "# SPDX-License-Identifier: MIT\nx = 1\n"), ("s/b.py", "// SPDX-License-Identifier: GPL-2.0-or-later\n"), ("s/c.py", "# SPDX-License-Identifier: Apache-2.0\n"), ("n/x.py", "x = 1\n"),
    )}
    assert found == {
        "b/LICENSE": "BSD-3-Clause", "g/COPYING": "GPL-3.0", "h/three.py": "GPL-3.0", "h/two.py": "GPL-2.0", "i/LICENSE": "ISC", "m/LICENSE": "MIT", "a/x.c": "Apache-2.0",
        "s/a.py": "MIT", "s/b.py": "GPL-2.0", "s/c.py": "Apache-2.0", "n/x.py": None,
    }
