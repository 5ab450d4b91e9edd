import random

from terrafold.llm import licenses

from .conftest import words


def test_odd_documents_and_the_empty_table(odd_docs, no_docs):
    got = licenses.scan_licenses(odd_docs).collect()
    assert [(r["doc_id"], r["license"], r["start"], r["end"], r["coverage"]) for r in got] == [(11, "MIT-notice", 0, 30, 1.0)] and licenses.scan_licenses(no_docs).count() == 0


def test_planted_and_edited_templates_are_found_where_they_stand(spark):
    rng, rows, want = random.Random(2), [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        if len(w) > 15:  # a word less, a word more, a word changed
            del w[7]
            w.insert(9, "inserted")
            w[12] = "changed"
        before = words(rng, rng.randint(1, 50)) + " é "
        rows.append((i, before + " ".join(w).upper() + " " + words(rng, 20)))
        want[i] = (name, len(before))
    rows.append((99, words(rng, 3000)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (name, start) in want.items():
        assert [(r["start"], r["coverage"] >= licenses.COVERAGE) for r in got if r["doc_id"] == i and r["license"] == name] == [(start, True)]
    assert all(r["doc_id"] != 99 for r in got)


def test_parts_of_licenses_are_found_and_measured_against_the_whole(spark):
    rng = random.Random(4)
    pieces = {}
    for name in licenses.WHOLE:
        parts = licenses.sections(licenses.TEMPLATES[name])
        pieces[name] = [" ".join(parts[:1]), " ".join(parts[1:]), " ".join(parts)]
    rows, want = [], {}
    for name, texts in pieces.items():
        total = len(texts[2].split())
        for text, begins in zip(texts, (0, len(texts[0].split()), 0)):
            before = words(rng, 9) + " "
            want[len(rows)] = (name, len(before), len(text.split()) / total, begins)
            rows.append((len(rows), before + text + " " + words(rng, 9)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (name, start, share, begins) in want.items():
        found = [(r["start"], round(r["coverage"], 6), r["license_offset"]) for r in got if r["doc_id"] == i and r["license"] == name]
        assert found == [(start, round(share, 6), begins)], name


def test_short_notices_with_a_changed_word_are_found(spark):
    rows = [(1, "abc Released under an MIT License. xyz"), (2, "Licensed under our Apache License, Version 2.0."), (3, "Released under one other thing"), (4, "released under the mit"), (5, "license")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"], round(r["coverage"], 3)) for r in got} == {(1, "MIT-notice", 0.8), (2, "Apache-2.0-notice", 0.857), (4, "MIT-notice", 0.8)}


def test_matches_equal_unbanded_alignment():
    """Matched words and spans of edited sections against the whole table of a longest common subsequence."""
    rng = random.Random(9)
    for _ in range(60):
        section = [rng.randrange(40) for _ in range(rng.randint(9, 60))]
        part = list(section)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = [rng.randrange(100, 140)] * rng.randint(0, 1)
        before, after = [rng.randrange(200, 300) for _ in range(rng.randint(0, 5))], [rng.randrange(200, 300) for _ in range(5)]
        part = before + part + after
        row = [0] * (len(part) + 1)
        for x in section:
            last, row = row, [0]
            for k, y in enumerate(part):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        matched, first, end = licenses.align(section, part, len(before))
        assert matched == row[-1] and set(part[first:end]) >= set(part[first : first + 1]) and len(before) <= first < end <= len(part) - 5
