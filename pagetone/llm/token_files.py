"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Layout of one dataset, below a folder that driver and executors share:

* ``part-NNNNN.bin``: the ids of a range of documents, one after the other, little-endian; two bytes each when
  every id fits, else four.
* ``part-NNNNN.idx``: per document its key and the end of its ids within the part, both int64, little-endian.

Documents are in ascending key order over the parts. A part's base, the number of ids before it, is a prefix
sum over the parts' counts, so no task waits for another. Files are mapped into memory when read.
"""

from __future__ import annotations

import gc
import re
import uuid
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetone.session import shared_folder

END_ID = 0
MIB_PER_PART = 24
#: Words a worker remembers with their ids. Then a new generation begins: words met again move into it, the others of the one
#: before are forgotten (memory, not results).
REMEMBERED = 550_000
#: New words that are encoded as one text, and texts that are cut together.
LOT, TEXTS_AT_ONCE = 256, 1024
NO_KEY = -(1 << 63)  # key of documents whose key is null

# A blank that meets more white space, read widely; such texts go to the library whole. The letter by which
# the vocabulary shows a blank before a word.
_WIDE = r"[\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
_BLANK = "\u0120"
_MARKS = tuple(",.;:!?")  # each is a piece of its own after letters
_LIBRARIES: dict[str, tuple] = {}


def _library(path: str) -> tuple:
    """The tokenizer, loaded once in each worker: which ids begin with a blank, texts that go whole, words met so far."""
    if path not in _LIBRARIES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        starts = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, i in tokenizer.get_vocab().items():
            starts[i] = token.startswith(_BLANK)
        wide = [c for c in map(chr, [*range(0x3001), 0xFEFF]) if c != " " and re.match(_WIDE, c)]
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        _LIBRARIES[path] = (tokenizer, starts, ([(c, f" {c}", f"{c} ") for c in wide], ["  ", *special]), [{}, {}])
    return _LIBRARIES[path]


def _cuttable(text: str, mixed: tuple) -> bool:
    """Whether no blank meets other white space and no special token is in the text. One search for each character
    is faster than a pattern of all."""
    wide, whole = mixed
    return not any(s in text for s in whole) and not any(c in text and (a in text or b in text) for c, a, b in wide)


def _ids_of_words(tokenizer, starts: np.ndarray, words: list[str], code: str) -> list[bytes]:
    """Ids of each word with a blank before it. Words are encoded in lots, as one text, and cut where a blank begins."""
    size, out = array(code).itemsize, []
    lots = [words[k:k + LOT] for k in range(0, len(words), LOT)]
    encoded = tokenizer.encode_batch_fast([" " + " ".join(lot) for lot in lots], add_special_tokens=False)
    for lot, e in zip(lots, encoded, strict=True):
        ids = np.array(e.ids, dtype=f"<u{size}")
        at = np.flatnonzero(starts[ids])
        if len(at) != len(lot) or at[0]:  # a word that does not stand alone
            alone = tokenizer.encode_batch_fast([" " + w for w in lot], add_special_tokens=False)
            out += [array(code, x.ids).tobytes() for x in alone]
            continue
        flat, ends = ids.tobytes(), [*(at * size).tolist(), len(ids) * size]
        out += [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    return out


def encode_texts(path: str, texts: list[str | None], dtype: str) -> list[bytes]:
    """Ids of each text and the end id, as little-endian bytes. Null counts as empty.

    The library splits a text before every blank that follows no white space, so such words are encoded
    once and remembered; only new ones reach the library. Texts in which a blank meets other white space, and
    those that hold the string of a special token, go to it whole.
    """
    tokenizer, starts, mixed, generations = _library(path)
    code = {"<u2": "H", "<u4": "I"}[dtype]
    end = array(code, [END_ID]).tobytes()
    texts = [t or "" for t in texts]
    cut = [_cuttable(t, mixed) for t in texts]
    words = pc.split_pattern(pa.array([t for t, c in zip(texts, cut, strict=True) if c], pa.large_string()), " ")
    flat, ends = _flat_ids(words, tokenizer, starts, generations, code)
    # The first word has no blank before it, so it is encoded by itself; all others are remembered with theirs.
    alone = [t.partition(" ")[0] if c else t for t, c in zip(texts, cut, strict=True)]
    out, row = [], 0
    for c, first in zip(cut, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        ids = array(code, first.ids).tobytes()
        if c:
            ids += flat[ends[row][0]:ends[row][1]]
            row += 1
        out.append(ids + end)
    return out


def _flat_ids(words: pa.ListArray, tokenizer, starts: np.ndarray, generations: list[dict], code: str) -> tuple[bytes, list[tuple[int, int]]]:
    """Ids of all words with their blanks, end to end, and where those of each text's words but the first lie in them."""
    if not len(words):
        return b"", []
    coded = words.values.dictionary_encode()
    own, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if len(generations[0]) > REMEMBERED:
        generations[:] = [{}, generations[0]]
    known, before = generations

    marked, new = [], set()
    for w in own:
        if w in known:
            continue
        ids = before.get(w)
        if ids is None and w.endswith(_MARKS) and w[:-1].isalpha():
            marked.append(w)
            w = w[:-1]
            ids = known.get(w) or before.get(w)
        if ids is None:
            new.add(w)
        else:
            known[w] = ids
    some = list(new)
    known.update(zip(some, _ids_of_words(tokenizer, starts, some, code), strict=True))
    mark = {m: array(code, tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in _MARKS} if marked else {}
    for w in marked:
        known[w] = known[w[:-1]] + mark[w[-1]]

    size = array(code).itemsize
    found = list(map(known.__getitem__, own))
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // size
    first = np.cumsum(length) - length
    table = np.frombuffer(b"".join(found), dtype=f"<u{size}")
    count = length[places]
    until = np.cumsum(count)
    at = np.repeat(first[places] - (until - count), count)
    at += np.arange(len(at))
    until = np.append(0, until) * size
    offsets = words.offsets.to_numpy()
    return table[at].tobytes(), list(zip(until[offsets[:-1] + 1].tolist(), until[offsets[1:]].tolist(), strict=True))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(files, path: str, write) -> None:
    """Write under a name of this attempt's own and then move: a repeated task leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, path)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id",
                 text: str = "text", dtype: str = "<u2", parts: int | None = None) -> DataFrame:
    """Encode and write ``docs``; returns the manifest (part, path, n_docs, n_tokens, base), one row per part.

    Texts are shuffled once, by ranges of (key, hash of the text), so repeated keys spread too; null texts are
    empty, null keys come first. The job runs here. A lost executor only repeats its parts.
    ``dtype`` is "<u2" for vocabularies of up to 65,536 ids, else "<u4". No rows give an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if parts is None:
        total = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        parts = max(1, ceil(total / (MIB_PER_PART << 20)))
    ordered = (slim.withColumn("mix", F.xxhash64("text")).repartitionByRange(parts, "key", "mix")
               .sortWithinPartitions("key", "mix"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        keys, ends = [], []

        def body(out) -> None:
            at = 0
            for batch in batches:
                texts = batch["text"].tolist()
                gc.disable()  # the word table holds no cycles, and walking it again and again costs a tenth of the time
                try:
                    for k in range(0, len(texts), TEXTS_AT_ONCE):
                        for ids in encode_texts(tokenizer_path, texts[k:k + TEXTS_AT_ONCE], dtype):
                            out.write(ids)
                            at += len(ids) // int(dtype[-1])
                            ends.append(at)
                finally:
                    gc.enable()
                keys.append(np.array([NO_KEY if pd.isna(x) else int(x) for x in batch["key"]], dtype="<i8"))

        path = f"{root}/part-{part:05d}"
        _put(files, f"{path}.bin", body)
        index = np.stack([np.concatenate(keys), np.array(ends, dtype="<i8")], axis=1) if ends else np.empty((0, 2), "<i8")
        _put(files, f"{path}.idx", lambda out: out.write(np.ascontiguousarray(index).tobytes()))
        yield pd.DataFrame({"part": [part], "path": [f"{folder}/part-{part:05d}"], "n_docs": [len(ends)],
                            "n_tokens": [int(ends[-1]) if ends else 0]})

    rows = ordered.mapInPandas(write, "part int, path string, n_docs bigint, n_tokens bigint").collect()  # one per part
    manifest = spark.createDataFrame([tuple(r) for r in rows if r["n_docs"]],
                                     "part int, path string, n_docs bigint, n_tokens bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(path: str, dtype: str) -> np.ndarray:
    """The file as an array; local files are mapped, so only the pages that are used are read."""
    files, name = _filesystem(path)
    if files.type_name == "local":
        from pathlib import Path

        return np.memmap(name, dtype=dtype, mode="r") if Path(name).stat().st_size else np.empty(0, dtype)
    with files.open_input_file(name) as source:
        return np.frombuffer(source.read_buffer(), dtype=dtype)


def read_tokens(manifest: DataFrame, key: str = "doc_id", dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files of the manifest.

    ``start`` counts the ids of all documents before it. The checksum covers the ids as 32-bit integers.
    One task reads one part.
    """
    import zlib

    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                index = _mapped(f"{path}.idx", "<i8").reshape(-1, 2)
                ids = _mapped(f"{path}.bin", dtype)
                ends = index[:, 1]
                starts = np.concatenate([[0], ends[:-1]])
                for a in range(0, len(ends), 1000):
                    spans = list(zip(starts[a:a + 1000].tolist(), ends[a:a + 1000].tolist(), strict=True))
                    keys = pd.array(index[a:a + 1000, 0], dtype="Int64")
                    keys[index[a:a + 1000, 0] == NO_KEY] = pd.NA
                    out = pd.DataFrame({
                        key: keys, "start": starts[a:a + 1000] + int(base),
                        "n_tokens": ends[a:a + 1000] - starts[a:a + 1000],
                        "ids_crc32": [zlib.crc32(ids[s:e].astype("<u4")) for s, e in spans]})
                    if with_ids:
                        out["ids"] = [ids[s:e].astype("int32") for s, e in spans]
                    yield out

    count = manifest.count()
    return manifest.select("part", "path", "base").repartition(max(1, count), "part").mapInPandas(read, schema)
