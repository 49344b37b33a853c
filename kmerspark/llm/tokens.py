"""Token ids in flat binary files with 64-bit document offsets, memory-mapped for reading."""

from __future__ import annotations

import itertools
import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read_table, text_or_empty

#: Words whose ids are remembered in a task; when full, the table starts anew.
MAX_WORDS = 1_200_000
MARKS = string.punctuation
DTYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
END_ID = 2


#: A tokenizer is taken for one that treats words apart only if it treats this text so.
SAMPLE = "Words apart: some_thing, (else) it's  won't\n\n two  blanks\tand a tab, 3.14 x-y ÄÖ ñ 日本語 😀 http://a.b/c?d=e\n end. A a"


class WordEncoder:
    """Encodes texts through a word table filled by the tokenizer.

    A tokenizer that drops white space and never lets a token span it gives a text the ids of its parts between
    blanks and line feeds, in order; equal parts are encoded once. (Whether it does so is seen by its vocabulary, which must hold no white space or
    mark of it, and by a sample text; with any other tokenizer whole texts are encoded.) Parts are found and put together again as
    Arrow columns. Plain words (nothing but letters that the tokenizer, too, takes for one letter of a word, perhaps with ASCII punctuation at the end,
    which it splits off whole) are remembered without their punctuation, encoded many at a time and told apart by word numbers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.table: dict[str, bytes | None] = {"": None}  # None: no plain word
        self.others: dict[str, bytes] = {"": b""}  # parts that are no plain word with marks, and the marks
        self.letters: dict[str, bool] = {}
        marks = re.compile(r"\s|[\u0120\u010a\u2581]")  # a byte-level blank or line feed, or a piece's leading blank
        parts = [p for p in SAMPLE.replace("\n", " ").split(" ") if p]
        longer = (t for t in (t.removesuffix("</w>") for t in self.tokenizer.get_vocab()) if len(t) > 1)  # single symbols join nothing
        self.by_words = not any(marks.search(t) for t in longer) and b"".join(map(self._one, parts)) == self._one(SAMPLE)

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, DTYPES[self.width]).tobytes()

    def _one(self, part: str) -> bytes:
        return self._ids(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _letter(self, c: str) -> bool:
        """Whether the tokenizer keeps ``c`` in a word, at its end and inside, and apart from a mark behind it."""
        if c not in self.letters:
            ends, inside = (self.tokenizer.encode(t, add_special_tokens=False).word_ids for t in (f"a{c}!", f"a{c}a!"))
            self.letters[c] = all(w[-1] == 1 and set(w[:-1]) == {0} for w in (ends, inside))
        return self.letters[c]

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha() and (w.isascii() or all(map(self._letter, set(w))))]
        self.table.update(dict.fromkeys(new))
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            numbers, raw, k = np.array(e.word_ids, float), self._ids(e.ids), self.width
            if not len(numbers) or not (numbers[-1] == len(some) - 1 and (np.diff(numbers) >= 0).all()):
                continue  # these are encoded apart, with their marks
            cuts = (k * np.searchsorted(numbers, np.arange(len(some) + 1))).tolist()
            self.table.update((w, raw[a:b]) for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are encoded as they are."""
        new = list(set(parts).difference(self.others))
        if len(self.others) + len(new) > MAX_WORDS:
            self.others, new = {"": b""}, list(set(parts) - {""})
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            self.others.update(zip(some, (self._ids(e.ids) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)), strict=True))
        return [self.others[p] for p in parts]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each of the different parts of texts."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        n_marks = np.diff(_ends_of(words)) - np.diff(_ends_of(stems))
        stems = stems.dictionary_encode()
        names, at = _strings(stems.dictionary), stems.indices.to_numpy()
        ids = list(map(self.table.get, names, itertools.repeat(b"?")))  # an odd length: no ids
        missing = [i for i, x in enumerate(ids) if x == b"?"]
        new = [names[i] for i in missing]
        if len(self.table) + len(new) > MAX_WORDS:
            self.table = {"": None}
            missing, new = range(len(names)), names
        self._learn(new)
        for i in missing:
            ids[i] = self.table[names[i]]
        is_plain = np.array([x is not None for x in ids], bool)[at]
        out = pa.array(ids, pa.large_binary()).take(stems.indices)
        marked = np.flatnonzero(is_plain & (n_marks > 0))
        tails = np.full(len(words), None, object)
        tails[marked] = self._known([w[-n:] for w, n in zip(_strings(words.take(pa.array(marked))), n_marks[marked].tolist(), strict=True)])
        whole = np.flatnonzero(~is_plain)
        tails[whole] = self._known(_strings(words.take(pa.array(whole))))
        return pc.binary_join_element_wise(out, pa.array(tails, pa.large_binary()), pa.scalar(b"", pa.large_binary()), null_handling="skip")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the places where they end (a 0 first)."""
        dtype = DTYPES[self.width]
        if not self.by_words:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for some in ids for x in some], dtype), np.cumsum([0, *map(len, ids)])
        texts = texts.cast(pa.large_string())
        ends = _ends_of(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy()
        ends = ends - ends[0]
        data[data == 10] = 32
        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = data == 32
        begins[ends] = True
        edges = np.flatnonzero(begins)
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        words = pc.ascii_rtrim(parts.dictionary, characters=" ").dictionary_encode()  # the last part of a text has no blank behind it
        coded = self._words(words.dictionary).take(words.indices).take(parts.indices)
        bounds = _ends_of(coded)
        flat = np.frombuffer(coded.buffers()[2] or b"", dtype, int(bounds[-1]) // self.width)
        return flat, bounds[np.searchsorted(edges, ends)] // self.width

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _ends_of(a: pa.Array) -> np.ndarray:
    """Offsets of a large string or binary array."""
    return np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset) if len(a) else np.zeros(1, np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process, kept while the Python worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in the store the cluster shares."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def _in_pieces(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of bounded total bytes, so that one batch of very long texts needs no more memory."""
    held, size = [], 0
    for b in batches:
        sizes = np.asarray(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), np.int64)
        first = 0
        while first < len(sizes):
            full = int(np.searchsorted(np.cumsum(sizes[first:]), most - size)) + 1  # rows that fill the piece
            some = b.slice(first, full)
            held.append(some)
            size += int(sizes[first : first + full].sum())
            first += full
            if size >= most:
                yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in range(2))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in range(2))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, order: list[Column], key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text and write the ids, in ``order``, as flat files; return the manifest, a row per file.

    Layout: ``ids-*.bin`` holds the ids of consecutive documents as little-endian unsigned integers (2 bytes where the
    vocabulary fits, else 4), each document ended by ``end_id``; ``offsets-*.bin`` holds little-endian unsigned 64-bit
    offsets, in ids, of the documents and of the end, within the file; ``keys-*.bin`` their keys as signed 64-bit
    integers (a null key is the smallest). The manifest gives each file's place in the order, its counts and ``base``, the
    ids of all files before it: the prefix sum of the files' totals. A document's global offset is base + offset.

    A task that runs again writes files of other names; the manifest, written last, names the ones that count. A null
    text is an empty document (just ``end_id``); equal keys and repeated rows keep a document each, and rows that are equal in
    ``order`` come in any order; a very long text is encoded whole, with little else beside it; an empty table
    gives an empty manifest; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    slim = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    slim = slim.withColumn("_tie", F.monotonically_increasing_id())  # rows of equal keys, or none, need not be one range
    by = [*(F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))), F.col("_tie")]
    slim = slim.repartitionByRange(n, *by).sortWithinPartitions(*by).select("key", "text", F.spark_partition_id().alias("pid"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fs, name, files, pid = word_encoder(tokenizer), None, uuid.uuid4().hex, {}, 0
        n_docs = n_ids = 0

        def pids() -> Iterator[pa.RecordBatch]:
            nonlocal pid
            for b in batches:
                if b.num_rows:
                    pid = b.column(2)[0].as_py()
                    yield b

        for keys, texts in _in_pieces(pids()):
            if fs is None:
                fs, path = _filesystem(folder)
                fs.create_dir(path, recursive=True)
                files = {k: fs.open_output_stream(f"{path}/{k}-{name}.bin") for k in ("ids", "offsets", "keys")}
            ids, ends = encoder.encode_column(texts)
            files["ids"].write(np.insert(ids, ends[1:], end_id).tobytes())
            files["offsets"].write((n_ids + ends[:-1] + np.arange(len(texts))).astype("<u8").tobytes())
            files["keys"].write(keys.fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(texts), n_ids + len(ids) + len(texts)
        if n_docs:
            files["offsets"].write(np.array([n_ids], "<u8").tobytes())
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"pid": [pid], "name": [name], "width": [encoder.width], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("pid", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = materialize(slim.mapInArrow(write, "pid int, name string, width int, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return written.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


class _Remote:
    """Numbers of a file in a store that can't be mapped; slices are read when asked for."""

    def __init__(self, file, dtype: np.dtype) -> None:
        self.file, self.dtype, self.n = file, dtype, file.size() // dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, some: slice) -> np.ndarray:
        a, b, _ = some.indices(self.n)
        return np.frombuffer(self.file.read_at(max(b - a, 0) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def open_tokens(folder: str, name: str, width: int) -> tuple:
    """(ids, offsets, keys) of one file set, memory-mapped where the store is a file system of this machine, else read by slices."""
    fs, path = _filesystem(folder)
    import pyarrow.fs as pafs

    out = []
    for kind, dtype in (("ids", DTYPES[width]), ("offsets", np.dtype("<u8")), ("keys", np.dtype("<i8"))):
        place = f"{path}/{kind}-{name}.bin"
        out.append(np.memmap(place, dtype, "r") if isinstance(fs, pafs.LocalFileSystem) else _Remote(fs.open_input_file(place), dtype))
    return tuple(out)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                ids, offsets, keys = open_tokens(folder, m["name"], m["width"])
                for i in range(0, len(keys), 5000):
                    at = offsets[i : i + 5001].astype(np.int64)
                    wide = ids[int(at[0]) : int(at[-1])].astype("<u4").view(np.uint8).data
                    first = at[0]
                    crc = [zlib.crc32(wide[4 * (a - first) : 4 * (e - first)]) for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    k = keys[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == -(1 << 63)), pa.array(at[:-1] + m["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(n, "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files written in ascending doc_id order."""
    folder = new_path(spark, "tokens")
    manifest = write_tokens(read_table(spark, sf_dir, "documents"), folder, tokenizer_path(), [F.col("doc_id")])
    return read_tokens(manifest, folder)
