"""Registered queries against DuckDB SQL, or against brute force over the same rows."""

import zlib

import compare
import numpy as np
import pandas as pd
import pytest

from pagetone.llm.oracle import ORACLE
from pagetone.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    wrong, n, only_spark, only_sql = compare.differences(spark, compare.connect(sf_dir), QUERIES[name], ORACLE[name], sf_dir)
    assert not wrong and not only_spark and not only_sql
    assert n > 0


def brute_fingerprint(text, width=3):
    import xxhash

    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(ids)}


def test_simhash(spark, sf_dir, docs):
    got = QUERIES["op3_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for t in docs["text"]]
    want = brute_components(docs["doc_id"].tolist(), fps)
    assert len(got) == len(docs)
    assert [got.loc[i, "fingerprint"] for i in docs["doc_id"]] == [f"{f:016x}" for f in fps]
    assert {i: got.loc[i, "component_id"] for i in docs["doc_id"]} == want


def test_sharding(spark, sf_dir, docs):
    from pagetone.llm.sharding import SHARDS, TABLE_SIZE, lookup_table

    got = QUERIES["op4_sharding"](spark, sf_dir).toPandas()
    owner = lookup_table([f"shard-{k:05d}" for k in range(SHARDS)], TABLE_SIZE)
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert (owner[got["slot"]] == got["shard"]).all()


def test_token_files(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op8_token_files"](spark, sf_dir).toPandas().set_index("doc_id")
    start = 0
    for i, text in sorted(zip(docs["doc_id"], docs["text"], strict=True)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        row = got.loc[i]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_mixing(spark, sf_dir, docs):
    from pagetone.llm.mixing import BLOCK_TOKENS, targets

    got = QUERIES["op9_mixing"](spark, sf_dir).toPandas().merge(docs[["doc_id", "source"]], on="doc_id")
    again = QUERIES["op9_mixing"](spark, sf_dir).toPandas()
    assert (got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist())
    sizes = {i: len(words(t)) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert (got["size"] == got["doc_id"].map(sizes)).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    sources = got.groupby("source").agg(size=("size", "sum"), one=("source_size", "first"), target=("target", "first"),
                                        taken=("taken", "sum"))
    assert (sources["size"] == sources["one"]).all()
    want = targets(sources["size"].to_dict(), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources.index))})
    for s, row in sources.iterrows():
        assert row["target"] == pytest.approx(want[s])
        assert row["target"] <= 3 * row["size"] + 1e-6
        assert 0 <= row["target"] - row["taken"] < 1 + BLOCK_TOKENS
    assert sources["target"].sum() == pytest.approx(sources["size"].sum())


def test_html_keeps_articles(spark, sf_dir):
    import html
    import re

    got = QUERIES["op10_html_text"](spark, sf_dir).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    assert len(got) == len(pages)
    for page_id, source in zip(pages["page_id"], pages["html"], strict=True):
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got.loc[page_id, "text"] == want
        assert got.loc[page_id, "n_chars"] == len(want)


def _held_out(frame, modulus, remainder):
    return frame["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % modulus == remainder)


@pytest.mark.parametrize(("name", "label", "fold", "accuracy"), [
    ("op2_toxicity", "toxic", (3, 1), 0.88), ("op6_quality", "quality", (5, 0), 0.85)])
def test_classifiers(spark, sf_dir, docs, name, label, fold, accuracy):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) == len(docs)
    assert (got["held_out"] == _held_out(got, *fold)).all()
    assert got["score"].between(0, 1).all()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    seen = got[got["held_out"]].merge(labels, on="doc_id")
    assert (seen["predicted"] == seen[label]).mean() >= accuracy
