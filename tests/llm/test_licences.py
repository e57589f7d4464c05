from panelflow.llm.licences import TEMPLATES, bigrams, scan_licences


def brute(text, least=0.8):
    import re
    lines = [x for x in re.split(r"[\r\n]+", text or "") if x.strip()]
    blocks = [b.strip("\r\n") for b in re.split(r"\r?\n(?:[ \t\x0b\x0c\r]*\n)+", text or "")]
    blocks = [b for b in blocks if len([x for x in b.split("\n") if x.strip()]) > 1]
    out = []
    for p in lines + blocks:
        g = bigrams(p)
        best = max(((2 * len(g & bigrams(t)) / max(len(g) + len(bigrams(t)), 1), name) for name, t in TEMPLATES.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if g and best[0] >= least:
            out.append((p, best[1], round(best[0], 9)))
    return out


TEXTS = [
    "some words\nReleased under the MIT License.\nmore words", "RELEASED under  the mit licence", "released under the mit license - see file",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without\nlimitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the\nSoftware, and to permit persons to whom the Software is furnished to "
    "do so, subject to the following conditions:\n\nother text here\nand there",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.\r\nLicensed under CC BY 4.0.", "under the license", "license",
    "Licensed under the Apache License, Version 2.0." * 40, "é" * 100 + "\nLicensed under the Apache License, Version 2.0.",
]


def test_against_brute_force(make, odd_rows):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4])] + [(100, r[1]) for r in odd_rows]
    got = sorted((str(r["id"]), r["passage"], r["licence"], round(r["dice"], 9)) for r in scan_licences(make(rows)).collect())
    assert got == sorted((str(i), *x) for i, t in rows for x in brute(t))
    assert len(got) >= 8


def test_places_and_own_templates(make):
    r = scan_licences(make([(1, TEXTS[-1])])).first()
    assert (r["start"], r["length"]) == (201, len(r["passage"]))
    got = scan_licences(make([(1, "all rights reserved by us")]), templates={"own": "All rights reserved by us", "x": ""}).collect()
    assert [g["licence"] for g in got] == ["own"]
    assert scan_licences(make([])).collect() == []
