import re

from lexigrid.llm import license_scan as L
from lexigrid.llm.queries import op2_license_scans

from .helpers import clashing, frame, texts


def slow(paragraph):
    """The family by plain Python: weights of the words and pairs, softmax, template check; None if unknown."""
    m = L.model()
    words = L.words_of(paragraph)
    known = [g for g in L.grams_of(words) if g in m["weights"]]
    if not any(" " not in g for g in known):
        return None
    p = L._softmax([x / m["temperature"] for x in L._logits(known, m["weights"], m["bias"])])
    best = p.index(max(p))
    if best == len(p) - 1 or p[best] < m["least"]:
        return None
    own = {f"{a} {b}" for a, b in zip(words, words[1:])}
    for sentence in L.TEMPLATES[m["families"][best]]:
        w = L.words_of(sentence)
        template = {f"{a} {b}" for a, b in zip(w, w[1:])}
        if len(own & template) / len(template) >= L.CONFIRMED:
            return m["families"][best]
    return None


def test_templates_and_their_variations_are_found():
    for family, sentences in L.TEMPLATES.items():
        for s in sentences:
            assert slow(s) == family, s
            assert slow(s.upper() + " Copyright 2020 the authors") == family, s
    for s in L.OTHERS + ("", "The weather was nice and the sea calm.", "License", "He licensed the version under the bridge", "reserved rights all"):
        assert slow(s) is None, s


def test_identifiers_name_their_own_family():
    for name, family in {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "GPL-2.0-only": "GPL", "GPL-3.0-or-later": "GPL", "LGPL-2.1-or-later": "LGPL", "MPL-2.0": "MPL-2.0", "CC-BY-SA-4.0": "CC-BY-SA", "CC0-1.0": "public-domain"}.items():
        assert slow(f"// SPDX-License-Identifier: {name}") == family
    assert slow("SPDX-License-Identifier: Zlib") is None


def test_queries_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["matches"] for r in op2_license_scans(spark, sf).collect()}
    by = texts(spark, sf)
    assert set(got) == set(by)
    for doc, text in by.items():
        found = [(i, slow(p)) for i, p in enumerate((text or "").split("\n")) if p.strip(" ")]
        assert got[doc] == ",".join(f"{i}:{f}" for i, f in found if f), doc
    named = {d for d, t in by.items() if re.search(r"(?m)^(Released under the MIT License|Licensed under |This work is licensed under the GNU|All rights reserved\.)", t or "")}
    assert named == {d for d, m in got.items() if m}


def test_edge_cases(spark):
    s = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (3, f"x\n\n{s}\n{s}\nAll rights reserved."), (4, s), (4, s), (None, "Released under the MIT License."), (5, "word " * 200_000 + s), (6, " \n\t\n")]
    out = L.license_scan(clashing(frame(spark, rows), "pos", "paragraph", "family", "id", "n"))
    got = sorted(((r["doc_id"], r["n_licences"], r["families"], r["matches"]) for r in out.collect()), key=str)
    none = (0, "", "")
    assert got[:2] == [(1, *none), (2, *none)]
    assert (3, 3, "Apache-2.0,all-rights-reserved", "2:Apache-2.0,3:Apache-2.0,4:all-rights-reserved") in got
    assert got.count((4, 1, "Apache-2.0", "0:Apache-2.0")) == 2 and (None, 1, "MIT", "0:MIT") in got and len(got) == 8
    assert L.license_scan(frame(spark, [])).count() == 0


def test_wrapped_paragraphs_are_found(spark):
    bsd = """Copyright (c) 2020, the authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
    lgpl = """/*
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation.
 *
 * Nothing else is said here.
 */"""
    one = "All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    part = "Permission is hereby granted, free of charge,\nto any person obtaining a copy"
    prose = "He wrote of the weather and the sea.\nNothing in the software was new\nand the conditions were as they had been."
    rows = [(1, bsd), (2, lgpl), (3, one), (4, part), (5, prose), (6, "Released under the MIT License.\nReleased under the MIT\nLicense."), (7, bsd.replace("\n", "\r\n")), (1, bsd), (None, lgpl)]
    got = [(r["doc_id"], r["matches"]) for r in L.license_scan(frame(spark, rows)).collect()]
    three = "0:all-rights-reserved,2:BSD,5:BSD"
    expected = [(1, three), (1, three), (2, "1:LGPL"), (3, "0:all-rights-reserved,1:BSD"), (4, "0:MIT"), (5, ""), (6, "0:MIT,1:MIT"), (7, three), (None, "1:LGPL")]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_model_is_bounded_and_deterministic():
    first = L.model()
    L.model.cache_clear()
    assert L.model() == first and len(first["weights"]) <= L.FEATURES


def test_no_python_in_the_plan(spark):
    plan = L.license_scan(frame(spark, [(1, "All rights reserved.")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
