"""Operator 12 against both tokenizers on whole texts and a plain search for overlaps."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from tokenizers import Tokenizer

from factorframe.llm import token_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_levels():
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LEVELS = byte_levels()


def tokens(text):
    """(id, bytes) of both tokenizers, or nothing."""
    if not text:
        return None
    a = [(i, bytes(LEVELS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[1:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(text):
    """Groups as text, and linked id pairs with repeats."""
    got = tokens(text)
    if got is None:
        return 0, 0, None, []
    a, b = map(spans, got)
    common = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, last = [], 0
    for c in common:
        inside = [[str(i) for i, s, e in side if s >= last and e <= c] for side in (a, b)]
        groups.append(",".join(inside[0]) + "|" + ",".join(inside[1]))
        last = c
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    return len(a), len(b), groups, links


def brute(rows):
    made = [(d, *plain(t)) for d, t in rows]
    held = Counter(pair for *_, links in made for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    out = []
    for d, n_a, n_b, groups, links in made:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, n_a, n_b, len(groups or []), len(links), sum(held[x] == highest[x[0]] for x in links), sum(held[x] for x in links), sha))
    return sorted(out, key=str)


def check(df, **kw):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ta.align(df, **kw).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows)
    return got


def short(df, n=2000):
    from pyspark.sql import functions as F

    return df.where(F.coalesce(F.length("text"), F.lit(0)) < n)


def test_whole_texts(small):
    check(short(small))


HARD = ["a  b", " lead", "trail ", "\n\n x \t y ", "a b c", "　 z", "x\x1c y \x1f z", "<|endoftext|> <s> </s> <0x41>", "mixed ▁ mark", "▁", " ", "  ",
        "don't  you'll ' s", "naïve é ﬁ ǅ", "слово и слово", "東京 は 日本", "\U0001f600 \U0001f1e9\U0001f1ea x", "a\0b c", "12 345,6 7", "﻿ bom", "a\r\n b", "end  line", "-- -- --", "x" * 300 + " y"]


def test_odd(spark, odd, none):
    from pyspark.sql import functions as F

    check(odd.where(F.coalesce(F.length("text"), F.lit(0)) < 5000))
    assert ta.align(none).collect() == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (3, HARD[3])], "doc_id long, text string")
    check(df)
    check(df, chunk=5, fan=2)


def test_long_documents_as_ranges_and_tree(spark, odd):
    """Byte ranges that cut words, characters and runs of spaces give what one range gives; repeated long rows stay apart."""
    texts = [" ".join(HARD) * 3, "ünï cödé 東京 " * 40, "no-space" * 60, "word " * 100, " " * 77, "a " * 30 + "▁"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    whole = check(df)
    for chunk, fan in ((16, 2), (37, 3), (200, 8)):
        assert check(df, chunk=chunk, fan=fan) == whole
    one = odd.where("doc_id in (7, 8)")  # several ranges at the default size
    parts = sorted(map(tuple, ta.align(one).collect()))
    assert parts == sorted(map(tuple, ta.align(one, chunk=1 << 30).collect())) and parts[0][1] > 80_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "a", "word", "é", "東", "\n", " ", "▁", "'s", "12", "<", "\U0001f600"]), max_size=25).map("".join),
       st.integers(1, 9), st.randoms())
def test_monoid(text, chunk, random):
    """Any way of composing the fragments gives the same document."""
    aligner = ta.loaded(*ta.paths())
    data = text.encode()
    parts = [ta.fragment(aligner, data[i:i + chunk]) for i in range(0, len(data), chunk)] or [(False, b"", b"", None)]
    while len(parts) > 1:
        at = random.randrange(len(parts) - 1)
        parts[at:at + 2] = [ta.composed(aligner, parts[at:at + 2])]
    groups, sizes, codes, times = ta.finished(aligner, parts[0])
    n_a, n_b, want, links = plain(text)
    if not text or want is None:
        assert not text or sizes >= ta._BAD
    else:
        assert (groups.split(";"), dict(zip(codes.tolist(), times.tolist()))) == (want, Counter(a << 32 | b for a, b in links))


def test_blocks_do_not_matter(spark, small, monkeypatch):
    want = check(short(small, 800))
    monkeypatch.setattr(ta, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ta, "PAIRS", 50)
    monkeypatch.setattr(ta, "CACHE", 10)
    cloudpickle.register_pickle_by_value(ta)  # so that tasks see the values above
    try:
        assert sorted((tuple(r) for r in ta.align(short(small, 800)).select(*COLUMNS).collect()), key=str) == want
    finally:
        cloudpickle.unregister_pickle_by_value(ta)


@pytest.mark.parametrize("n", [400])
def test_hot_pair(spark, n):
    check(spark.createDataFrame([(i, "the same words" if i % 3 == 0 else f"the {i} others") for i in range(n)], "doc_id long, text string"))
