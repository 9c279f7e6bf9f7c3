"""Alignment of two tokenizers against the tokenizers themselves and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askwell.llm import alignment
from askwell.plans.inputs import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def byte_of():
    """Byte-level spelling: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in kept]
    return {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(rest)}


def plain(texts, tokenizers):
    a, b = tokenizers
    spelled, out, held = byte_of(), [], Counter()
    for text in texts:
        ta = tb = []
        if text:
            ea = a.encode(" " + text, add_special_tokens=False)
            ta = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in ea.ids]
            tb = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                tb.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
                ta = tb = []
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (ta, tb)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], Counter(), 0, 0
        for end in common:
            ga, gb = [], []
            while i < len(ta) and ends[0][i] <= end:
                ga.append(ta[i][0])
                i += 1
            while j < len(tb) and ends[1][j] <= end:
                gb.append(tb[j][0])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            for x, n in Counter(ga).items():
                for y, m in Counter(gb).items():
                    links[x, y] += n * m
        held.update(links.keys())
        out.append((len(ta), len(tb), groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if held[x, y] == most[x]),
             sum(n * held[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for na, nb, groups, links in out]


ODD = ["", None, " ", "  two  spaces ", "a▁b", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "漢字かな 🙂🙂 é ﬁ", "\t\n x \r\n  y z　w ", "=" * 3001, "x" + "=" * 2000,
       " " * 777, "word", "word", "ab " * 20_000, "tab\tonly\n\n\nlines\n ", "0123456789" * 50, "\u0000 \u0001 ​"]


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_alignment_of_awkward_texts(spark, tokenizers):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id bigint, text string")
    for name in ("row", "pair", "held", "best", "times", "links", "n_a"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert rows(alignment.cross_tokenizer(docs.repartition(3))) == [(i, *x) for i, x in enumerate(plain(ODD, tokenizers))]


def test_alignment_of_documents(spark, tokenizers):
    docs = table(spark, SF, "documents").orderBy("doc_id").select("doc_id", "text")
    texts = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(texts, plain([r.text for r in texts], tokenizers))]
    assert rows(alignment.cross_tokenizer(docs)) == want
    assert rows(alignment.cross_tokenizer(docs, head=50)) == want  # rare pairs by a shuffle


def test_long_texts_come_in_parts(tokenizers, monkeypatch):
    texts = [r for r in ODD if r] + ["Some words and some more words, again and again. " * 50]
    both = alignment.Pair(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    import pyarrow as pa
    whole = alignment.link_batch(both, pa.array(range(len(texts))), texts, 0).to_pylist()
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "LINKS", 100)
    monkeypatch.setattr(alignment, "MOST_STRETCHES", 5)
    assert alignment.link_batch(both, pa.array(range(len(texts))), texts, 0).to_pylist() == whole
    assert [tuple(r[k] for k in ("n_a", "n_b", "n_groups", "n_links")) for r in whole] == [x[:4] for x in plain(texts, tokenizers)]


def test_overlaps_and_groups_of_tokens(spark):
    docs = spark.createDataFrame([(1, "Un mot très inhabituel, übermäßig"), (2, None), (None, "tokens")], "doc_id bigint, text string")
    both = alignment.pair(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    for row in alignment.token_groups(docs).collect():
        ends = [np.cumsum([len(table[i]) for i in ids]) for table, ids in ((both.a_bytes, row.a_ids), (both.b_bytes, row.b_ids))]
        starts = [e - [len(table[i]) for i in ids] for e, table, ids in ((ends[0], both.a_bytes, row.a_ids), (ends[1], both.b_bytes, row.b_ids))]
        want = [(i, j) for i in range(len(row.a_ids)) for j in range(len(row.b_ids)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
        assert list(zip(row.a_overlaps, row.b_overlaps)) == want
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist())) if row.a_ids else []
        assert row.a_groups == [sum(c <= s for c in cuts) for s in starts[0]] if row.a_ids else row.a_groups == []
        assert row.b_groups == [sum(c <= s for c in cuts) for s in starts[1]] if row.b_ids else row.b_groups == []


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.cross_tokenizer(empty).collect() == []
