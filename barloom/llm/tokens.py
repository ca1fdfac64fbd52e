"""Token ids as flat unsigned files with 64-bit document offsets."""

from __future__ import annotations

import array
import functools
import json
import mmap
import os
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, lean, materialize, partitions, qualified, shared_path, small_batches

#: Fixed value: the first bytes of an index file.
MAGIC = b"BLTOKEN1"
#: Bytes of ids after which a task starts its next pair of files.
ROLL = 128 << 20
#: Distinct pieces whose ids a worker remembers; once full, others are encoded batch by batch.
REMEMBERED = 500_000
OTHERS = re.compile(r"[^\x09-\x0d\x20-\u024f]|<\|")


def _pieces() -> re.Pattern:
    """The pre-tokenizer's pattern of word_bpe_49k.json for lower-cased characters below U+0250.

    Its alternatives are fixed values; \\p{L} and \\p{N} are spelled out for these characters.
    """
    known = sorted({c for i in range(0x250) for c in chr(i).lower()})
    letters, numbers = ("".join(re.escape(c) for c in known if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0d\\x20\\x85\\xa0{letters}{numbers}]+")


PIECES = _pieces()

# The rules of word_bpe_49k.json that PIECES and OTHERS stand for.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None, "padding": None, "post_processor": None,
}


def _by_rule(loaded: dict) -> bool:
    """Whether a vocabulary's rules are RULES, with no added tokens but such as start with <|."""
    return all(loaded.get(k) == v for k, v in RULES.items()) and all(t["content"].startswith("<|") for t in loaded.get("added_tokens", []))


def _byte_letters() -> dict:
    """The printable stand-ins of byte-level BPE: bytes that are not printable Latin-1 follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in plain)}


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece of a text encoded once.

    The vocabulary lower-cases, splits by PIECES and encodes pieces one by one, so a text's
    ids are its pieces' ids in a row. Texts of characters below U+0250 (which NFC leaves as
    they are, and which are lower-cased one by one) are split here and their pieces given to
    the library's model; others, and texts that may hold a special token, go to the library whole, as do
    all texts where the vocabulary has other rules than these.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok, self.known, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.split = _by_rule(json.loads(self.tok.to_str()))
        self.model = self.tok.model
        self.width = 2 if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.end = self._bytes([end_id])

    def _bytes(self, ids) -> bytes:
        return array.array("H" if self.width == 2 else "I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(piece)])

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text (null: none) and the end id, as bytes in this machine's order."""
        split = [PIECES.findall(t.lower()) if self.split and t and not OTHERS.search(t) else None for t in texts]
        ids = {x: self._piece(x) for x in set().union(*filter(None, split)).difference(self.known)}
        if len(self.known) < REMEMBERED:
            self.known |= ids
            ids = {}
        get = self.known.__getitem__ if not ids else lambda w: self.known.get(w) or ids[w]
        whole = [i for i, x in enumerate(split) if x is None and texts[i]]
        found = self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        rest = {i: self._bytes(e.ids) for i, e in zip(whole, found)}
        return [(b"".join(map(get, x)) if x else rest.get(i, b"")) + self.end for i, x in enumerate(split)]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder for all the tasks of a Python worker."""
    return Encoder(path, end_id)


def _writer(folder: str, encoder, batch: int, roll: int):
    """Writes the rows of a task, in their order, as pairs of files; returns their manifest rows."""

    def write(batches):
        from pyspark import TaskContext

        part, enc, made = TaskContext.get().partitionId(), encoder(), []
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        out, ids, ends = None, [], [0]

        def close():
            nonlocal out, ids, ends
            out.close()
            name = made[-1][2]
            with fs.open_output_stream(f"{top}/{name}.idx") as f:
                f.write(MAGIC + struct.pack("<QQ", len(ids), enc.width))
                f.write(np.array(ends, dtype="<u8").tobytes())
                f.write(np.array([x or 0 for x in ids], dtype="<i8").tobytes())
                f.write(np.array([x is None for x in ids], dtype="u1").tobytes())
            made[-1] = (part, len(made) - 1, f"{folder}/{name}", len(ids), ends[-1])
            out, ids, ends = None, [], [0]

        for pdf in batches:
            texts = pdf["text"].tolist()
            named = [None if pd.isna(x) else int(x) for x in pdf["doc_id"].astype("Int64")]
            for i in range(0, len(texts), batch):
                if out is None:
                    made.append((part, len(made), f"part-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}"))
                    out = fs.open_output_stream(f"{top}/{made[-1][2]}.bin")
                data = enc.encode(texts[i : i + batch])
                ids += named[i : i + batch]
                ends += (ends[-1] + np.cumsum([len(x) // enc.width for x in data])).tolist()
                out.write(b"".join(data))
                if ends[-1] * enc.width >= roll:
                    close()
        if out is not None:
            close()
        if made:
            yield pd.DataFrame(made, columns=["part", "seq", "path", "docs", "tokens"])

    return write


def write_tokens(docs: DataFrame, encoder, folder: str, batch: int = 256, roll: int = ROLL) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order (nulls first); the manifest, with bases.

    encoder() gives an object whose encode(texts) gives each text's ids as bytes. Documents
    are range-partitioned by doc_id; a task writes pairs of files, a new one once `roll` bytes are
    reached, so a reader's buffer is bounded (but for a document longer than that): <part>.bin, ids as flat little-endian unsigned
    integers of 16 bits (32 where the vocabulary needs them), and <part>.idx: magic, document
    count, bytes of an id, count + 1 offsets of 64 bits into the ids, doc_ids of 64 bits, and a byte a document that is 1 for a null id. Names
    are unique to the attempt, and only files of finished tasks are in the manifest, which
    is written once: lost executors and repeated tasks leave unread files at most.
    `base`, the ids before a part, is a prefix sum over the manifest, a row a part.
    """
    small_batches(docs.sparkSession)
    parts = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = parts.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = materialize(rows.mapInPandas(lean(_writer(folder, encoder, batch, roll)), "part int, seq int, path string, docs long, tokens long"), "manifest")
    found, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["seq"])):
        found.append((*r, base))
        base += r["tokens"]
    spark = docs.sparkSession
    manifest = spark.createDataFrame(found, "part int, seq int, path string, docs long, tokens long, base long")
    return manifest.repartition(max(1, len(found)), "path")


def _mapped(fs, path: str):
    """A file's bytes: memory-mapped if it is local, else as one buffer (of about ROLL bytes)."""
    if isinstance(fs, pafs.LocalFileSystem) or getattr(fs, "type_name", "") == "local":
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""
    with fs.open_input_file(path) as f:
        return f.read()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The files of a manifest -> (doc_id, start, n_tokens, ids_crc32), headers and lengths checked."""

    def read(batches):
        for pdf in batches:
            for name, n_docs, tokens, base in zip(pdf["path"], pdf["docs"], pdf["tokens"], pdf["base"]):
                fs, path = filesystem(name)
                idx, data = _mapped(fs, path + ".idx"), _mapped(fs, path + ".bin")
                n, width = struct.unpack_from("<QQ", idx, len(MAGIC))
                if idx[: len(MAGIC)] != MAGIC or width not in (2, 4) or n != n_docs or len(idx) != len(MAGIC) + 16 + 8 * (n + 1) + 9 * n:
                    raise ValueError(f"{name}.idx: not an index of {n_docs} documents")
                at = len(MAGIC) + 16
                offsets = np.frombuffer(idx, dtype="<u8", count=n + 1, offset=at).astype(np.int64)
                ids = np.frombuffer(idx, dtype="<i8", count=n, offset=at + 8 * (n + 1))
                null = np.frombuffer(idx, dtype="u1", count=n, offset=at + 8 * (2 * n + 1)) > 0
                if offsets[0] != 0 or (np.diff(offsets) < 0).any() or offsets[-1] != tokens or width * tokens != len(data):
                    raise ValueError(f"{name}: offsets and ids disagree")
                flat = np.frombuffer(data, dtype=f"<u{width}")
                for i in range(0, n, 2_000):
                    j = min(n, i + 2_000)
                    view = memoryview(flat[offsets[i] : offsets[j]].astype("<u4")).cast("B")
                    at = 4 * (offsets[i : j + 1] - offsets[i])
                    crc = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pd.DataFrame(
                        {"doc_id": pd.array(np.where(null[i:j], None, ids[i:j]), dtype="Int64"), "start": base + offsets[i:j], "n_tokens": np.diff(offsets[i : j + 1]), "ids_crc32": np.array(crc, dtype=np.int64)}
                    )

    return manifest.mapInPandas(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes all documents (null text: empty) with a vocabulary of word_bpe_49k.json's rules; reads them back.

    `vocabulary` names a file beside the public_tokenizers package, or a path that every
    executor has. end_id is appended to each document. Without a folder the files live in the shared
    folder, as long as the application does. Rows that repeat a doc_id follow each other, by a hash of their
    texts; very long texts are encoded whole; other columns are ignored. An empty table returns no rows.
    """

    def encoder():
        import public_tokenizers

        return encoder_of(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), end_id)

    folder = qualified(docs.sparkSession, folder or shared_path(docs.sparkSession, "tokens"))
    return read_tokens(write_tokens(docs, encoder, folder))
