import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from widestat.llm import token_count
from widestat.llm.queries import vocabulary_path

from .conftest import by_id


def library(vocabulary, byte_fallback, unknown=0):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).tokens)


BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
#: Many equal sums, so ties decide.
TIED = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0),
        ("▁ab", -4.0), ("bb", -1.5), ("é", -3.0), ("bé", -4.0), ("abab", -4.0), ("cc", -1.0)]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_equals_the_library_on_ties(byte_fallback):
    vocabulary = TIED + BYTES if byte_fallback else TIED
    want, counter = library(vocabulary, byte_fallback), token_count.Counter(vocabulary)

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet="ab cé▁x\n世", max_size=14))
    def check(text):
        assert counter.tokens(text) == (want(text) if text else 0)
    check()


def test_equals_the_library_on_the_public_vocabulary():
    vocabulary = token_count.load_vocabulary(vocabulary_path())
    want, counter = library(vocabulary, True), token_count.Counter(vocabulary)

    @settings(max_examples=200, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
        ["the", "tion", "enthe", "Öß", " ", "\n", ".", "ción", "42", "<s>", "<0x41>", "  "]), max_size=12).map("".join)))
    def check(text):
        assert counter.tokens(text) == (want(text) if text else 0)
    check()


def test_whole_documents(spark):
    vocabulary = token_count.load_vocabulary(vocabulary_path())
    want = library(vocabulary, True)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(token_count.count_tokens(documents, vocabulary))
    for r in documents.collect():
        assert got[r.doc_id].n_tokens == want(r.text)


def test_edge_rows(docs):
    rows = [(1, None), (2, ""), (3, "ab" * 200_000), (4, "ab"), (4, "ab"), (None, "ab")]
    got = token_count.count_tokens(docs(rows), TIED)
    assert got.columns == ["doc_id", "n_chars", "n_tokens"] and got.count() == 6
    assert by_id(got)[1].n_tokens == by_id(got)[2].n_tokens == 0 and by_id(got)[3].n_chars == 400_000
    assert token_count.count_tokens(docs([]), TIED).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(docs(rows), [])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_SEGMENTS", 5)
    counter = token_count.Counter(TIED)
    counter.tokens(" ".join("a" * i for i in range(50)))
    assert len(counter) <= 5
