from inkstone.llm import licenses

from .conftest import prose, rows


def _split(text):
    table = {c: " " for c in range(128) if not chr(c).isalnum()}
    return (text or "").translate(table).lower().split()


def _pairs(words):
    return list(zip(words, words[1:]))


def every(text, template, threshold):
    """All stretches of a text against one template, the best first, without overlaps."""
    pairs, own = _pairs(_split(text)), set(_pairs(_split(template)))
    scored, taken = [], []
    for first in range(len(pairs)) if own.intersection(pairs) else ():
        found, common = set(), 0
        for last in range(first, len(pairs)):
            if pairs[last] not in found:
                found.add(pairs[last])
                common += pairs[last] in own
            if 2 * len(own) < threshold * (len(found) + len(own)):
                break  # no longer stretch can reach it
            if 2 * common >= threshold * (len(found) + len(own)):
                scored.append((-2 * common / (len(found) + len(own)), first, last + 1))
    for dice, first, last in sorted(scored):
        if all(last <= a or b <= first for _, a, b in taken):
            taken.append((dice, first, last))
    return sorted((first, last - first + 1, round(-dice, 9)) for dice, first, last in taken)


def brute(text, templates, threshold):
    """All stretches of a text against every template; no bound prunes anything."""
    return sorted((name, *found) for name, template in templates.items() for found in every(text, template, threshold))


def _texts():
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-notice"]
    words = mit.split()
    changed = " ".join(w if k % 23 else f"other{k}" for k, w in enumerate(words))
    return [
        (1, prose(40, 1) + "\n" + mit.upper() + "\n" + prose(30, 2)),
        (2, changed),
        (3, " ".join(words[: len(words) // 2])),
        (4, "Released under the MIT License. " + prose(9, 3) + " released UNDER the mit license"),
        (5, apache + "\n\n" + prose(5, 5) + licenses.TEMPLATES["BSD-2-Clause"]),
        (6, prose(100, 6)),
        (7, "released under the"),
        (8, "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0."),
    ]


def test_same_as_brute_force(spark):
    docs = _texts()
    found = licenses.scan(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    ours = {r["doc_id"]: sorted((m["license"], m["word"], m["n_words"], round(m["dice"], 9)) for m in r["matches"]) for r in found.collect()}
    expected = {d: brute(t, licenses.TEMPLATES, licenses.THRESHOLD) for d, t in docs}
    assert ours == expected
    assert expected[1] and expected[2] and not expected[3] and len(expected[4]) == 2 and not expected[6] and not expected[7]
    assert {r["doc_id"]: r["license"] for r in found.collect()}[1] == "MIT"


def test_lines_in_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = licenses.scan(spark, spark.read.parquet(f"{small}/documents.parquet")).collect()
    ours = {r["doc_id"]: sorted((m["license"], m["word"], m["n_words"], round(m["dice"], 9)) for m in r["matches"]) for r in found}
    assert ours == {r["doc_id"]: brute(r["text"], licenses.TEMPLATES, licenses.THRESHOLD) for r in docs}


def test_odd_rows(spark, odd, empty):
    found = licenses.scan(spark, odd)
    assert rows(found, "doc_id") == rows(odd, "doc_id")
    assert not found.filter("n_matches <> 0 or license is not null or size(matches) <> 0").count()
    assert licenses.scan(spark, empty).count() == 0


def test_same_as_every_stretch(spark):
    gpl, mit = licenses.TEMPLATES["GPL-3.0-notice"], licenses.TEMPLATES["MIT"]
    words, half = gpl.split(), len(gpl.split()) // 2
    inserted = lambda share: " ".join(words[:half] + prose(int(len(words) * share), 9).split() + words[half:])
    docs = [
        (1, f"{prose(9, 1)} {inserted(0.2)} {prose(9, 2)}"),
        (2, inserted(0.3)),
        (3, inserted(0.6)),
        (4, f"{gpl} {gpl} {inserted(0.1)} {' '.join(words[:-9])} {gpl}"),
        (5, f"{prose(20, 3)} {mit}"),
    ]
    for name in ("GPL-3.0-notice", "MIT"):
        own = {name: licenses.TEMPLATES[name]}
        found = licenses.scan(spark, spark.createDataFrame(docs, "doc_id long, text string"), templates=own).collect()
        ours = {r["doc_id"]: sorted((m["word"], m["n_words"], round(m["dice"], 9)) for m in r["matches"]) for r in found}
        assert ours == {d: every(t, own[name], licenses.THRESHOLD) for d, t in docs}
        if name == "MIT":
            assert ours[5][0][2] == 1
        else:
            assert ours[1] and ours[2] and not ours[3] and len(ours[4]) > 1
