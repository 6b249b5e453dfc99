import math
import os
from collections import Counter

from scenelake.llm import licenses

FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("lib/a/code.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\n" + "y = 2\n" * 50),
    ("lib/a/LICENSE.txt", "some words before the notice\nThis work is licensed under the GNU General Public License, version 3.\n"),
    ("lib/a/b/deep.py", "nothing to see"),
    ("lib/c/deep.py", "nothing to see"),
    ("top.py", ""),
    ("lib/c/none.py", None),
    (None, "All rights reserved."),
    ("lib/c/none.py", None),
    ("a//b", "words only"),
]


def test_own_and_inherited(spark):
    df = spark.createDataFrame([(p, t, "x") for p, t in FILES], "path string, text string, license string")
    got = {r.path: (r.own_license, r.license, r.from_dir) for r in licenses.scan(df).collect()}
    assert got == {
        "LICENSE": ("MIT", "MIT", None),
        "lib/a/code.py": ("Apache-2.0", "Apache-2.0", None),
        "lib/a/LICENSE.txt": ("GPL-3.0", "GPL-3.0", None),
        "lib/a/b/deep.py": (None, "GPL-3.0", "lib/a"),
        "lib/c/deep.py": (None, "MIT", ""),
        "lib/c/none.py": (None, "MIT", ""),
        "top.py": (None, "MIT", ""),
        None: ("Proprietary", "Proprietary", None),
        "a//b": (None, "MIT", ""),
    }


def test_near_notices_go_to_the_likest_template(spark):
    notes = {"GPL-2.0": "this work is licensed under the gnu general public license version 2", "CC-BY-4.0": "LICENSED UNDER CC BY 4.0"}
    df = spark.createDataFrame([(f"d/{k}", f"pad pad\n{v}") for k, v in notes.items()], "path string, text string")
    assert {r.path[2:]: r.own_license for r in licenses.scan(df).collect()} == {k: k for k in notes}


def test_texts_headers_and_wrapped_notices(spark):
    texts = {}
    for file in os.listdir(licenses._FOLDER):
        with open(os.path.join(licenses._FOLDER, file)) as f:
            texts[file.removesuffix(".txt")] = f.read()
    code = [f"value{i} = compute{i}(argument{i}, other{i})" for i in range(60)]
    comment = lambda text: "\n".join("# " + x for x in text.split("\n"))
    rows, want = [], {}
    for key, text in texts.items():
        name = key.removesuffix(".header")
        if key == name:
            rows.append((f"{key}/code.txt", f"Copyright (c) 2020 Some Body\n\n{text}"))
            rows.append((f"{key}/below/x.py", "\n".join(code)))
            want[f"{key}/below/x.py"] = (None, name, key)
            want[f"{key}/code.txt"] = (name, name, None)
        if len(text) < 3000:
            rows.append((f"headers/{key}.py", "\n".join(code[:9]) + "\n" + comment(text) + "\n" + "\n".join(code)))
            want[f"headers/{key}.py"] = (name, name, None)
    rows.append(("wrapped.py", "\n".join([*code[:5], "# Licensed under the", "# Apache License, Version 2.0.", *code])))
    want["wrapped.py"] = ("Apache-2.0", "Apache-2.0", None)
    rows.append(("none.py", "\n".join(code)))
    want["none.py"] = (None, None, None)
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.own_license, r.license, r.from_dir) for r in licenses.scan(df).collect()}
    assert got == want


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_repeats_weigh_by_their_logarithm_and_ties_go_by_name(spark):
    """Scores of lines against a plain cosine, with repeats, long lines and equal templates."""
    notices = (("B", "alpha beta beta gamma"), ("A", "alpha beta beta gamma"), ("C", "delta delta delta epsilon"))
    lines = ["alpha beta beta gamma", "alpha alpha beta beta gamma zeta", "delta epsilon delta", "Delta, delta; epsilon! other", "alpha " * 5000 + "beta beta gamma", "eta theta", ""]
    df = spark.createDataFrame([(f"d/{i}", x) for i, x in enumerate(lines)] + [("d/0", lines[0])], "path string, text string")
    got = {r.path: (r.own_license, r.own_score) for r in licenses.scan(df, templates=notices, texts=()).collect()}
    units = [x.lower().replace(",", "").replace(";", "").replace("!", "").split() for x in [*lines, lines[0]]]
    total = sum(bool(u) for u in units)
    weight = lambda w: math.log((1 + total) / (1 + (sum(w in u for u in units) if any(w in n.split() for _, n in notices) else 0))) + 1
    vector = lambda words: {w: (1 + math.log(n)) * weight(w) for w, n in Counter(words).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, unit in enumerate(units[:-1]):
        u = vector(unit)
        scored = [(-sum(x * t.get(w, 0) for w, x in u.items()) / (size(u) * size(t)), name) for name, n in notices if u and (t := vector(n.split()))]
        best = min(((round(s, 6), name) for s, name in scored if s <= -0.6), default=None)
        assert got[f"d/{i}"] == ((best[1], -best[0]) if best else (None, None)), i
    assert got["d/0"][0] == "A"
