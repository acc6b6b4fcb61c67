"""The alignment of two tokenizers against one that takes whole texts and counts all links."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import crosstokens
from spanloom.llm.bpe import vocabulary_path

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "  a   b  ", "Hello world, it's fine.", "line\n\nnext line\t tab\r\n", "naïve café – “quote”", "日本語のテキスト と space",
    "x" * 3000, "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "plain ▁ mark", "\x00\x01 \x1c y", "nbsp  space 　wide ᠎ y", "🙂🙂 emoji 👩‍👩‍👧", "é combining", "0123456789 12,345.67", " \n a \n b", "the the the the the",
]


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def plain(texts, both):
    from spanloom.llm.bpe import byte_letters

    t, sp = both
    letters, rows = byte_letters(), []
    for text in texts:
        a = t.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        in_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        in_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or b"".join(in_a) != f" {text}".encode() or b"".join(in_b) != f" {text}".encode():
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f] if len(a) < 2000 else [(x, b[ends_b.index(e)]) for x, e in zip(a, ends_a, strict=True) if e in ends_b]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if before < e <= c) for ids, ends in ((a, ends_a), (b, ends_b))))
            before = c
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(p for r in rows if r for p in r[3])
    most = defaultdict(int)
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(n[p] == most[p[1]] for p in r[3]), sum(n[p] for p in r[3]), r[4]) for r in rows]


def frame(spark, texts):
    return spark.createDataFrame([(i // 2 if i % 5 else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int")


def test_every_text_is_as_with_whole_texts(spark, both):
    texts = [*TEXTS, *TEXTS[5:14]]
    found = crosstokens.report(frame(spark, texts)).collect()
    expected = [(i // 2 if i % 5 else None, *r) for i, r in enumerate(plain(texts, both))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_table_texts_and_joined_counts(spark, both, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    expected = sorted((r["doc_id"], *x) for r, x in zip(rows, plain([r["text"] for r in rows], both), strict=True))
    assert sorted(tuple(r) for r in crosstokens.report(docs).collect()) == expected
    monkeypatch.setattr(crosstokens, "mounted", lambda where: None)
    assert sorted(tuple(r) for r in crosstokens.report(docs).collect()) == expected
    counts = {(r["a"], r["b"]): r["n"] for r in crosstokens.pair_counts(docs).collect()}
    assert sum(counts.values()) == sum(r[4] for r in expected)


def test_runs_go_on_over_batches_and_flushes(spark, both, monkeypatch):
    import pyarrow as pa

    batch = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])
    found = [(k, n) for keys, counts in crosstokens.runs([batch([1, 1, 2], [1, 2, 3]), batch([2], [4]), batch([], []), batch([2, 5], [5, 6])]) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)]
    assert found == [(1, 3), (2, 12), (5, 6)]


def test_empty_tables(spark):
    assert crosstokens.report(frame(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in crosstokens.report(frame(spark, [None, "", None])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
