import random
import re

import pytest

from widestat.llm import licenses

from .conftest import by_id

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


TEXTS = [
    "Intro words.\nReleased under the MIT License.", "MIT License mit-license MIT  LICENSE", None, "",
    "Licensed under the Apache License, Version 2.0.", "the apache licenses", "GNU General\n * Public\n * License, version 3",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
    "# documentation files (the \"Software\"), to deal in the Software without restriction, including",
    "été MIT License", "İ MIT license", "the version of the license by the public", "x " * 100_000 + "mit license",
]


def test_base_equals_brute_force(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, TEXTS[0])]
    out = licenses.digest(licenses.scan_licenses(docs(rows)))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert out.count() == len(rows)
    got = by_id(out)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates(docs):
    got = by_id(licenses.digest(licenses.scan_licenses(docs(list(enumerate(TEXTS))))))
    assert got[0].labels == "mit" and got[0].score == 1.0
    assert got[4].labels == "apache,apache-2.0" and got[4].score == 1.0
    assert got[7].labels == "gpl,gpl-3.0" and got[8].labels == "cc-by-nc-4.0"
    assert got[9].labels == "mit" and got[9].base_labels == "" and got[9].score > 0.9
    assert got[12].labels == "" and got[12].score == 0.0


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def brute_templates(text, index):
    """{label: best score} from every offset of every template in the text."""
    postings, sequences, need, _ = index
    seq, best = licenses.words(text), {}
    for t, (label, _, phrases) in enumerate(licenses.TEMPLATES):
        terms = {w for w, places in postings.items() if any(x == t for x, _ in places)}
        size = len(sequences[t])
        for o in range(-size, len(seq)):
            hits = {(d, w) for d in range(o, o + licenses.SLACK + 1) for q, w in enumerate(sequences[t])
                    if w in terms and 0 <= d + q < len(seq) and seq[d + q] == w}
            if len({w for _, w in hits}) < need[t] or o not in {d for d, _ in hits}:
                continue
            window = seq[max(0, max(0, o) - licenses.SLACK):max(d for d, _ in hits) + size + licenses.SLACK]
            if all(f" {p} " in f" {' '.join(window)} " for p in phrases):
                best[label] = max(best.get(label, 0), longest_common(sequences[t], window) / size)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_score_equal_brute_force(seed):
    """Notices whole, cut, edited and mixed, between words of other notices."""
    rng, index = random.Random(seed), licenses.build_index({})
    pool = sorted(licenses.template_words())
    found = 0
    for _ in range(25):
        text = []
        for _, notice, _ in rng.sample(licenses.TEMPLATES, 2):
            words = notice.split()
            if rng.random() < 0.4:
                start = rng.randrange(len(words) // 2 + 1)
                words = words[start:start + rng.randint(2, len(words))]
            for _ in range(rng.choice((0, 0, 1, 3))):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice(([], [rng.choice(pool)], [words[at], rng.choice(pool)]))
            text += rng.choices(pool, k=rng.randint(0, 6)) + words
        text = " ".join(text)
        want, got = brute_templates(text, index), licenses.scan(text, index)
        base = set(filter(None, brute(text)[4].split(",")))
        assert set(got[5]) == base | set(want), text
        top = max(want.values(), default=0.0)
        assert 0.8 * top <= got[6] <= top, text
        found += bool(want)
    assert found > 10


@pytest.mark.parametrize("frequency", [{}, {"": 10_000, "license": 4_000, "the": 9_000, "software": 3_000, "of": 9_000}])
def test_every_notice_is_found_whole(frequency):
    index = licenses.build_index(frequency)
    for label, notice, _ in licenses.TEMPLATES:
        text = "Some words before it.\n" + notice.replace(" ", "\n# ", 5) + " and after it"
        got = licenses.scan(text, index)
        assert label in got[5] and got[6] == 1.0, (label, notice)


def test_versions_and_families_are_told_apart():
    index = licenses.build_index({})
    for label, notice, _ in licenses.TEMPLATES:
        got = set(licenses.scan(notice, index)[5])
        if label.startswith(("gpl-", "lgpl-", "agpl-", "cc-")):
            others = {x for x, _, _ in licenses.TEMPLATES if x.startswith(("gpl-", "lgpl-", "agpl-", "cc-"))} - {label}
            assert not got & others, (label, got)


def test_frequencies_cover_all_documents(docs):
    f = licenses.document_frequencies(docs([(1, "MIT license mit"), (2, "license"), (3, None)]))
    assert f[""] == 3 and f["license"] == 2 and f["mit"] == 1


def test_empty_table(docs):
    assert licenses.scan_licenses(docs([])).count() == 0


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(licenses.digest(licenses.scan_licenses(documents)))
    for r in documents.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)
