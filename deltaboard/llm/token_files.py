"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames. Each data frame holds the ids of whole
documents as little-endian unsigned 32-bit integers, up to ``frame_ids`` of them;
a longer document is cut over frames of its own. Then follow two skippable frames,
so any zstandard reader still decompresses the plain id stream:

* the document index: per document its id, a null flag, the start in the file's
  id stream and its number of ids;
* the seek table, in the public seekable format: per frame the compressed size,
  the decompressed size and the low 32 bits of XXH64 of the content, then the
  number of frames, a descriptor byte and the magic number.

A reader takes the last bytes, then the index, then only the frames it needs.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaboard.session import Staging

# Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 16
END_ID = 2
CACHE_ENTRIES = 1_200_000
RUN_WORDS = 1000
#: How pieces write the byte of a space.
SPACE = "Ġ"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """Writes documents to one file; ``close`` adds the index and the seek table."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        self.sink, self.most = sink, 4 * frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held_bytes and self.held_bytes + len(ids) > self.most:
            self._flush()
        for at in range(0, len(ids), self.most):
            part = ids[at : at + self.most]
            self.held.append(part)
            self.held_bytes += len(part)
            if self.held_bytes >= self.most:
                self._flush()
        count = len(ids) // 4
        self.index.append((doc_id or 0, doc_id is None, self.ids, count))
        self.ids += count

    def _frame(self, frame: bytes, content: bytes) -> None:
        self.sink.write(frame)
        self.seek.append((len(frame), len(content), checksum(content)))

    def _flush(self) -> None:
        content = b"".join(self.held)
        if content:
            self._frame(self.packer.compress(content), content)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        rows = np.array(self.index, dtype="<i8").reshape(-1, 4).tobytes()
        body = struct.pack("<I", checksum(rows)) + self.packer.compress(rows)
        self._frame(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body, b"")
        table = b"".join(struct.pack("<III", *row) for row in self.seek)
        table += struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FileReader:
    """Reads documents of one file; decompresses only the frames they lie in."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file: its seek table is missing")
        table = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), dtype="<u4").reshape(-1, 3)
        self.packed, self.plain, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.ids_at = np.concatenate([[0], np.cumsum(self.plain // 4)])
        body = source.read_at(int(self.packed[-1]), int(self.at[-2]))[8:]
        rows = zstandard.ZstdDecompressor().decompress(body[4:])
        if checksum(rows) != struct.unpack("<I", body[:4])[0]:
            raise ValueError("the document index is damaged")
        self.index = np.frombuffer(rows, dtype="<i8").reshape(-1, 4)

    def frame(self, k: int) -> bytes:
        packed = self.source.read_at(int(self.packed[k]), int(self.at[k]))
        content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.plain[k]))
        if checksum(content) != self.sums[k] or len(content) != self.plain[k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def document(self, row: int) -> Iterator[bytes]:
        """The ids of the document in the given row of the index, frame by frame."""
        start, count = int(self.index[row, 2]), int(self.index[row, 3])
        k = int(np.searchsorted(self.ids_at, start, side="right")) - 1
        while count:
            skip = start - int(self.ids_at[k])
            part = self._cached(k)[4 * skip : 4 * (skip + count)]
            yield part
            start, count, k = start + len(part) // 4, count - len(part) // 4, k + 1

    def _cached(self, k: int) -> bytes:
        if getattr(self, "last", (None, b""))[0] != k:
            self.last = (k, self.frame(k))
        return self.last[1]


class Encoder:
    """Ids of whole texts. Byte-level pieces are independent, so each is encoded once and kept.

    Texts are cut at single spaces, each kept with the word behind it: the pattern
    of the tokenizer always cuts there unless two white space characters meet, and
    such texts go through the pattern whole. Latin letters with marks behind them
    are cut without the pattern, which cuts them between the two. The kept entries
    are bounded.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # Spark's tasks are the threads here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.spaced = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.spaced[[number for piece, number in self.library.get_vocab().items() if piece.startswith(SPACE)]] = True
        self.pattern = regex.compile(pattern)
        self.doubled = re.compile(r"\s\s")
        self.plain = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")
        # Ids of pieces, and of texts between spaces with the space before them.
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: Iterable[str]) -> None:
        known, plain, findall = self.known, self.plain.fullmatch, self.pattern.findall
        words, others, cut = set(), set(), []
        for chunk in chunks:
            match = plain(chunk)
            if match is None:
                parts = findall(chunk)
                others.update(parts)
                cut.append((chunk, parts))
            elif match[2]:
                words.add(match[1])
                others.add(match[2])
                cut.append((chunk, match.groups()))
            else:
                words.add(chunk)
        others.update([w for w in words if w[0] != " "])
        words = [w for w in words.difference(others) if w not in known]
        # Words with a space before them are pieces behind one another too, and a space begins no other id of a word.
        runs = ["".join(words[k : k + RUN_WORDS]) for k in range(0, len(words), RUN_WORDS)]
        found = self.library.encode_batch_fast(runs, add_special_tokens=False) if runs else []
        self._keep(words, [f.ids for f in found], lambda ids: self.spaced[ids])
        others = list(others.difference(known))
        if others:
            found = self.library.encode(others, is_pretokenized=True, add_special_tokens=False)
            of = np.array(found.word_ids)
            self._keep(others, [found.ids], lambda _: np.diff(of, prepend=-1) != 0)
        for chunk, parts in cut:
            known[chunk] = b"".join([known[p] for p in parts])

    def _keep(self, pieces: list[str], runs: list[list[int]], first: Callable[[np.ndarray], np.ndarray]) -> None:
        """Keeps the ids of the pieces, given those of all; ``first`` says which of them begin a piece."""
        if not pieces:
            return
        ids = np.concatenate([np.array(run, dtype="<u4") for run in runs])
        starts = (np.nonzero(first(ids))[0] * 4).tolist()
        raw, known = ids.tobytes(), self.known
        for piece, start, end in zip(pieces, starts, [*starts[1:], len(raw)], strict=True):
            known[piece] = raw[start:end]

    def _cut(self, text: str) -> list[str]:
        if self.doubled.search(text):
            return self.pattern.findall(text)
        if "\0" in text:
            first, *rest = text.split(" ")
            return [first, *[" " + word for word in rest]]
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        docs = list(map(self._cut, texts))
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = set().union(*docs).difference(self.known)
        if new:
            self._learn(new)
        ids_of = self.known.__getitem__
        for doc in docs:
            yield b"".join(map(ids_of, doc))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _few(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters."""
    run, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Encodes ``doc_id, text`` and writes one file per range of doc ids; returns the manifest to be.

    The manifest has ``shard, path, n_docs, n_ids``; shard order is doc_id order.
    Each attempt of a task writes a file of its own name, and only the row of the
    attempt that Spark accepts names it, so lost executors leave no wrong file.
    A null doc_id comes first. A null text is empty: its document is the end id
    alone. Repeated doc ids stay together in the order of their texts. An empty
    table gives an empty manifest. Other columns are ignored.
    """
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = sink = None
        codec = encoder(tokenizer, pattern)
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None:
                shard = TaskContext.get().partitionId()
                name = f"{base}/ids-{shard:06d}-{uuid.uuid4().hex}.zst"
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(name, compression=None)
                writer = FileWriter(sink, frame_ids)
            names = iter(batch["doc_id"])
            for texts in _few(batch["text"]):
                for ids in codec.encode(texts):
                    doc_id = next(names)
                    writer.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pd.DataFrame({"shard": [shard], "path": [name], "n_docs": [len(writer.index)], "n_ids": [writer.ids]})

    return (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInPandas(write, "shard int, path string, n_docs long, n_ids long")
    )


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; with ``wanted``, only these.

    ``start`` counts the ids of all documents before it. Only frames that hold a
    wanted document are decompressed; each is checked against its checksum. The
    running total runs over one row per file, far fewer than documents.
    """
    only = None if wanted is None else set(wanted)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                with files.open_input_file(path) as source:
                    reader, rows = FileReader(source), []
                    for k, (doc_id, null, start, count) in enumerate(reader.index.tolist()):
                        if only is not None and (null or doc_id not in only):
                            continue
                        crc = 0
                        for part in reader.document(k):
                            crc = zlib.crc32(part, crc)
                        rows.append((None if null else doc_id, before + start, count, crc))
                        if len(rows) == 20_000:
                            yield _found(rows)
                            rows = []
                    yield _found(rows)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    spread = listed.repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _found(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = list(zip(*rows)) or [[]] * 4
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") for n, c in zip(names, columns)})


def token_round_trip(docs: DataFrame, tokenizer: str, pattern: str, stage: Staging) -> DataFrame:
    """Writes the files of ``docs`` into the staged folder and reads every document back."""
    folder = f"{stage.folder}/token-files"
    manifest = stage(write_token_files(docs, folder, tokenizer, pattern), "manifest")
    return read_token_files(manifest, folder)
