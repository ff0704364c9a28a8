from textrisk.llm.licenses import op8_license_scan, scan_licenses

FILES = [
    ("LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/x.py", "code\ncode"), ("a/y.py", "# Released under the MIT License.\ncode"),
    ("a/b/COPYING", "preamble\n\nThis work is licensed under the GNU General Public License, version 3."),
    ("a/b/z.py", None), ("a/b/c/d/deep.py", ""), ("a/b/c/d/deep.py", ""),
    ("a/bb/z.py", "no header but the word license alone in a very long unrelated sentence about birds"),
    ("other/file", "x " * 50_000 + "\nAll rights reserved.\n" + "y " * 50_000), (None, "Released under the MIT License."),
]


def scanned(spark, files):
    df = spark.createDataFrame([(p, t, "clash", 1) for p, t in files], "path string, text string, license string, dir int")
    return scan_licenses(df)


def test_own_and_inherited(spark):
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in scanned(spark, FILES).collect()}
    assert got["LICENSE"] == ("Apache-2.0", "Apache-2.0", None)
    assert got["a/x.py"] == (None, "Apache-2.0", "")
    assert got["a/y.py"] == ("MIT", "MIT", None)
    assert got["a/b/z.py"] == (None, "GPL-3.0", "a/b") and got["a/b/c/d/deep.py"] == (None, "GPL-3.0", "a/b")
    assert got["a/bb/z.py"] == (None, "Apache-2.0", "")
    assert got["other/file"] == ("proprietary", "proprietary", None)
    assert got[None] == (None, None, None)


def test_every_row_comes_back(spark):
    assert scanned(spark, FILES).count() == len(FILES)
    assert scanned(spark, []).count() == 0


def test_driver_documents(spark):
    lines = {"Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "General Public License, version 3": "GPL-3.0",
             "CC BY-NC 4.0": "CC-BY-NC-4.0", "All rights reserved": "proprietary"}
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_license_scan(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    per_dir = {}
    for r in docs:
        want = {v for k, v in lines.items() if k in r.text}
        if want:
            assert got[r.doc_id].own_license in want
        else:
            assert got[r.doc_id].own_license is None
        p = got[r.doc_id].path
        if "LICENSE" in p and want:
            d, least = p.rpartition("/")[0], per_dir.get(p.rpartition("/")[0], ("~",))[0]
            if p < least:
                per_dir[d] = (p, got[r.doc_id].own_license)
    for r in got.values():
        if r.own_license is None:
            parts = r.path.split("/")[:-1]
            near = [d for d in ("/".join(parts[:i]) for i in range(len(parts), -1, -1)) if d in per_dir]
            assert r.inherited_from == (near[0] if near else None)
            assert r.license == (per_dir[near[0]][1] if near else None)


MIT_BODY = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction")
WRAPPED = [
    ("long/line.c", " ".join(f"w{i}" for i in range(60)) + " licensed under the Apache License, Version 2.0 " + " ".join(f"v{i}" for i in range(60)), "Apache-2.0"),
    ("wrapped.c", "/*\n * This work is licensed under the GNU General\n * Public License,\n * version 2.\n */\nint x;", "GPL-2.0"),
    ("gpl2/COPYING", "\t\t GNU GENERAL PUBLIC LICENSE\n\t\t   Version 2, June 1991\n\n Everyone is told the following", "GPL-2.0"),
    ("gpl3/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "GPL-3.0"),
    ("bsd/LICENSE", "Copyright (c) 1999 Some One\nAll rights reserved.\n\nRedistribution and use in source and binary\nforms, with or "
                    "without modification,\nare permitted provided that", "BSD-3-Clause"),
    ("mit.h", MIT_BODY.replace("of charge", "of\n// charge"), "MIT"),
    ("closed.h", "Copyright 2020 Firm.\nAll rights\nreserved.", "proprietary"),
    ("foo.h", "Released under the Foo License. The License is long.", None),
    ("gnu.h", "licensed under the GNU General Public License", None),
    ("agpl.h", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
]


def test_headers_in_long_lines_and_across_line_ends(spark):
    got = {r.path: r.own_license for r in scanned(spark, [w[:2] for w in WRAPPED]).collect()}
    assert got == {p: want for p, _, want in WRAPPED}


def test_whole_texts_of_license_files(spark):
    from textrisk.llm.licenses import own_licenses, whole_licenses
    files = [(f"{name}/LICENSE", "Copyright (c) 2021 A. N. Other\n\n" + text.replace("\n", "\r\n")) for name, text in whole_licenses()]
    got = {r.path: r for r in own_licenses(spark.createDataFrame(files, "path string, text string"), templates=[("none", "xyzzy license")]).collect()}
    assert {p: r.license for p, r in got.items()} == {p: p.split("/")[0] for p, _ in files}
