from lexspark.llm.pretokens import Vocabulary, public_path
from lexspark.llm.terms import term_counts, weighted_sums
from lexspark.llm.token_counts import count_tokens


def test_counts_equal_the_library(documents):
    texts = [None, "", "Hello, world! It's 42.", "déjà vu  naïve\n\n", "日本語 text <|endoftext|> end", "a " * 3000, "=" * 400]
    vocabulary = Vocabulary(public_path())
    got = {r["doc_id"]: r for r in count_tokens(documents(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        n = len(vocabulary.whole(text or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_odd_rows(odd, empty):
    got = count_tokens(odd).collect()
    assert len(got) == odd.count() and count_tokens(empty).count() == 0
    assert len({r["n_tokens"] for r in got if r["doc_id"] in (3, 5)}) == 1


def test_rare_terms_join_as_head_terms_do(documents):
    blanks = lambda: lambda text: text.split()
    docs = documents((1, "a b b c"), (1, "a a d"), (2, None)).select("doc_id", "text")
    table = term_counts(docs, blanks).where("term != X'64'")
    for head in (0, 2, 100):
        got = sorted((r["doc_id"], r["n_terms"], r["total"], r["n_known"]) for r in weighted_sums(docs, blanks, table, "n", 0.5, head=head).collect())
        assert got == [(1, 3, 6.5, 2), (1, 4, 8.0, 4), (2, 0, 0.0, 0)]
