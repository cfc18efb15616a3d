"""BPE encoding and decoding that encodes content-defined chunks once and repairs their joins."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barlake.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: The rolling hash sees so many bytes; a blank is a cut if the hash's top byte is under DENSITY (of 256).
ROLL, DENSITY = 4, 248
MULTIPLIER, FINISH = 2_654_435_761, 2_246_822_519
#: Chunks that a worker remembers, in each of two generations.
REMEMBERED = 150_000
#: New chunks that the tokenizer gets in one call.
TOGETHER = 1024


def cuts(raw: bytes, density: int = DENSITY) -> list[int]:
    """Places after which a chunk begins: after an ASCII blank (space or line feed) where the hash of the last bytes says so. They depend on the bytes just before alone, so equal passages are cut alike in all documents."""
    a = np.frombuffer(raw, np.uint8)
    h = a.astype(np.uint32)
    for i in range(1, ROLL):
        h[i:] += a[:-i].astype(np.uint32) * np.uint32(pow(MULTIPLIER, i, 2**32))
    h = (h * np.uint32(FINISH)) >> np.uint32(24)
    return (np.flatnonzero(((a == 32) | (a == 10)) & (h < density)) + 1).tolist()


class Coder:
    """A tokenizer with the chunks that it has met. Results do not depend on what is remembered.

    `parted` states that the tokenizer parts text at white space and drops it, so that a join right after a blank changes no
    id; only joins before a mark that combines with what stands before are verified then. Without it every join is.
    """

    def __init__(self, path: str, parted: bool = True, density: int = DENSITY, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parted, self.density, self.remembered = parted, density, remembered
        self.young: dict[bytes, tuple[bytes, str]] = {}
        self.old: dict[bytes, tuple[bytes, str]] = {}
        self.plain_decode = self.tokenizer.decoder is None  # then decoding joins the tokens with blanks
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if self.plain_decode else []

    def _encode(self, chunks: list[bytes]) -> None:
        """Remember chunks that are not yet known. The tokenizer gets TOGETHER at a time, for its results take many times the room of the ids."""
        for lo in range(0, len(chunks), TOGETHER):
            some = chunks[lo : lo + TOGETHER]
            for chunk, one in zip(some, self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)):
                ids = one.ids
                self.young[chunk] = array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids]) if self.plain_decode else ""

    def _doubtful(self, chunk: bytes) -> bool:
        if not self.parted:
            return True
        return chunk[0] > 127 and unicodedata.category(chunk[:4].decode(errors="ignore")[:1] or "x")[0] in "MZC"

    def _known(self, chunk: bytes) -> tuple[bytes, str]:
        if (got := self.young.get(chunk)) is None:
            if (got := self.old.get(chunk)) is None:
                self._encode([chunk])
                return self.young[chunk]
            self.young[chunk] = got
        return got

    def _repaired(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks whose encodings joined are the encoding of the whole: where a join is doubtful and both sides together encode otherwise, they become one chunk."""
        out = chunks[:1]
        for chunk in chunks[1:]:
            if self._doubtful(chunk):
                both = out[-1] + chunk
                if self._known(both)[0] != self._known(out[-1])[0] + self._known(chunk)[0]:
                    out[-1] = both
                    continue
            out.append(chunk)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian, 32 bits each) and decoded text of every text; null counts as empty. All new chunks of the texts are encoded in one call, each once."""
        parts, doubts = [], []
        for text in texts:
            raw = (text or "").encode()
            at = [0, *cuts(raw, self.density), len(raw)]
            parts.append(chunks := [raw[i:j] for i, j in zip(at, at[1:]) if i < j])
            # only what begins beyond ASCII can be doubtful where the tokenizer parts at white space
            doubts.append(any(map(self._doubtful, chunks[1:])) if not (self.parted and raw.isascii()) else False)
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = {c for chunks in parts for c in chunks if c not in young}
        for c in [c for c in new if c in old]:
            young[c] = old[c]
            new.discard(c)
        self._encode(sorted(new))  # like chunks together, so that the tokenizer's own memory of words holds
        for chunks, doubt in zip(parts, doubts):
            whole = [young[c] for c in chunks] if not doubt else [self._known(c) for c in self._repaired(chunks)]
            ids = b"".join([w[0] for w in whole])
            if self.plain_decode:
                yield ids, " ".join([w[1] for w in whole if w[0]])
            else:
                yield ids, self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


#: One coder per worker process and setting, for all its tasks.
_CODERS: dict[tuple, Coder] = {}


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", parted: bool = True, with_ids: bool = True, with_text: bool = False, slice_chars: int = 1 << 20) -> DataFrame:
    """Per row: key, n_tokens, ids (array), decoded (text, on demand), ids_sha256, decoded_sha256.

    The ids are those of the tokenizer at `path` over the whole text without added special tokens; the path must be readable on every
    executor. A null or empty text has no ids and decodes to the empty text. Rows are independent: repeated rows give the
    same twice, null keys stay null, other columns are not looked at. Rows go through in slices of about `slice_chars` letters. One pass, no shuffle.
    """
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        coder = _CODERS.get((path, parted))
        if coder is None:
            coder = _CODERS[(path, parted)] = Coder(path, parted)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, size, texts = lo, 0, []
                while hi < batch.num_rows and size < slice_chars:
                    texts.append(batch.column(1)[hi].as_py())
                    size += len(texts[-1] or "")
                    hi += 1
                ids, digests, decoded, texts_out = [], [], [], []
                for raw, back in coder.encode(texts):
                    ids.append(raw)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    texts_out.append(back)
                columns = {"key": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), flat)
                if with_text:
                    columns["decoded"] = pa.array(texts_out, pa.string())
                columns |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)
                lo = hi

    kind = rows.schema["key"].dataType.simpleString()
    made = ", ids array<int>" * with_ids + ", decoded string" * with_text
    return rows.mapInArrow(run, f"key {kind}, n_tokens long{made}, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def vocabulary() -> str:
    """Path of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op6_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), vocabulary(), with_ids=False)
