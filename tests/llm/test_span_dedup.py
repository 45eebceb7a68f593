import random
import re
from bisect import bisect_left

import xxhash
from pyspark.sql import functions as F

from widestat.llm import span_dedup as S

from .conftest import by_id


def cut_points(text, window):
    """(start, end) of the words, and the numbers of those that open a piece:
    sentence starts, and in a longer sentence the least hash of each window."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    hashes = [xxhash.xxh3_64_intdigest(text[s:e].lower().encode()) for s, e in words]
    opens = {len(words)}
    for s, e in S.sentences(text):
        inside = range(bisect_left(words, (s,)), bisect_left(words, (e,)))
        opens.add(inside[0])
        if len(inside) > window:
            for k in range(len(inside) - window + 1):
                opens.add(min(inside[k:k + window], key=lambda w: hashes[w]))
    return words, sorted(opens)


def brute(rows, min_words=S.MIN_WORDS, window=S.WINDOW):
    """{id: set of removed offsets}: every run of pieces that holds min_words and
    no shorter run from or to the same piece, compared by its words."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        words, opens = cut_points(text or "", window)
        runs = {(i, next(j for j in opens if j - i >= min_words)) for i in opens if opens[-1] - i >= min_words}
        runs |= {(next(i for i in reversed(opens) if j - i >= min_words), j) for j in opens if j >= min_words}
        for i, j in sorted(runs):
            key = tuple(text[a:b].lower() for a, b in words[i:j])
            if key in seen:
                out.setdefault(d, set()).update(range(words[i][0], words[j - 1][1]))
            seen.add(key)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)

    def sentence():
        return " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 14))).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence() for _ in range(rng.randint(8, 14))) for _ in range(4)]
    rows = []
    for i in range(n):
        body = [sentence() for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = [rng.choice(passages)]
        rows.append((i, rng.choice((" ", "\n")).join(body)))
    return rows


def test_sentences():
    text = "A b. C d!\nE v1.5 f?  G"
    assert [text[s:e] for s, e in S.sentences(text)] == ["A b.", "C d!", "E v1.5 f?", "G"]
    assert S.sentences("") == [] and S.sentences(" \n ") == [] and [*S.sentences("...")] == [(0, 3)]


def test_equals_brute_force(docs):
    rows = corpus(1)
    want = brute(rows)
    got = {}
    for r in S.repeated_spans(docs(rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    texts = dict(rows)
    assert set(got) == set(want) and want
    for d in want:  # white space between two removed runs may differ
        assert all(texts[d][i].isspace() for i in got[d] ^ want[d])


def test_a_passage_of_over_50_words_is_removed_everywhere_but_first(docs):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(30)) + "."
    rows = [(i, f"Own {i} start here. {passage} Own {i} end.") for i in (4, 2, 9)]
    rows.append((1, "Nothing shared here at all. Really."))
    ranges = S.repeated_spans(docs(rows))
    clean = by_id(S.remove_ranges(docs(rows), ranges))
    assert passage in clean[2].text and clean[4].text == "Own 4 start here.  Own 4 end." and "p3" not in clean[9].text
    assert clean[1].text == rows[3][1]
    assert sorted(r.doc_id for r in S.digest(ranges).collect()) == [4, 9]


def test_repeats_inside_one_document(docs):
    run = "One two three four five six seven eight nine. Ten eleven twelve thirteen fourteen fifteen sixteen. " \
          "Aa bb cc dd ee ff gg hh ii jj kk."
    text = run + " Middle part here. " + run
    got = S.digest(S.repeated_spans(docs([(1, text)]))).collect()
    assert [(r.doc_id, r.ranges) for r in got] == [(1, f"{len(text) - len(run)}:{len(text)}")]


def test_edge_rows(docs):
    long = " ".join(f"Word{i} and more text number {i}." for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "Short."), (4, long), (5, long), (5, long), (None, long)]
    made = docs(rows).withColumn("start", F.lit("clash")).withColumn("h1", F.lit(1))
    got = S.digest(S.repeated_spans(made)).collect()
    assert sorted((r.doc_id or 0, r.removed_chars) for r in got) == [(0, len(long)), (5, len(long))]
    clean = S.remove_ranges(made, S.repeated_spans(made))
    assert clean.columns == made.columns and sorted(len(r.text or "") for r in clean.collect()) == [0, 0, 0, 0, 0, 6, len(long)]
    assert S.digest(S.repeated_spans(docs([]))).count() == 0


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id for r in S.digest(S.repeated_spans(documents)).collect()} == set(brute(rows))


def test_a_passage_of_51_words_cut_at_every_word_is_found(docs):
    """Its ends lie inside sentences, or it has none at all."""
    rng = random.Random(4)
    for punctuated in (True, False):
        words = [f"x{rng.randrange(10 ** 6)}" + ("." if punctuated and i % 23 == 22 else "") for i in range(160)]
        rows = [(0, "Start of it " + " ".join(words) + " and the end")]
        for at in range(len(words) - 50):
            own = [f"own{at}y{i}" for i in range(60)]
            rows.append((at + 1, " ".join(own[:30] + words[at:at + 51] + own[30:])))
        lost = {r.doc_id: r for r in S.digest(S.repeated_spans(docs(rows))).collect()}
        assert set(lost) == set(range(1, len(rows)))
        for d, text in rows[1:]:  # and nothing but words of the passage
            gone = " ".join(text[int(s):int(e)] for s, e in (r.split(":") for r in lost[d].ranges.split(",")))
            assert "own" not in gone and len(gone.split()) >= S.MIN_WORDS


def test_rows_without_an_id_or_with_a_shared_one_lose_only_their_own_repeats(docs):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(30)) + "."
    own = " ".join(f"u{i}" for i in range(200)) + "."
    rows = [(1, passage), (None, passage), (None, own), (3, "Before. " + passage), (3, own + " And more.")]
    clean = S.remove_ranges(docs(rows), S.repeated_spans(docs(rows))).collect()
    # Both texts of ids come first; the copies without an id go, all of them.
    assert sorted((r.doc_id or 0, r.text) for r in clean) == [
        (0, ""), (0, ""), (1, passage), (3, "Before. "), (3, own + " And more.")]
    alone = [(1, passage), (None, passage), (None, own)]
    clean = S.remove_ranges(docs(alone), S.repeated_spans(docs(alone))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in clean) == [(0, ""), (0, own), (1, passage)]


def test_a_span_of_every_document_is_cut_from_all_but_one(docs):
    """Folded in slices, scanned across batches."""
    passage = " ".join(f"p{i}" for i in range(40)) + "."
    rows = [(i, f"Own start of {i}. {passage}") for i in range(25_000)]
    lost = S.digest(S.repeated_spans(docs(rows, partitions=4)))
    assert lost.count() == 24_999 and lost.where("doc_id = 0").isEmpty()
