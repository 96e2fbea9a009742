"""SentencePiece encoding by a Viterbi search over batches of words, and decoding.

A text is cut before each run of spaces; no piece crosses such a cut. Distinct
chunks of equal length advance together: at each place the hashes of all
substrings that end there probe the sorted piece keys, and a vectorised maximum
picks the best predecessor. The best path has the largest sum of piece scores;
of equal paths, the one whose last piece is longest wins at each place. Long
chunks of a length that few others share, as texts without spaces have, take the
same path over the pieces that occur in them, found for all places at once.
Characters outside the vocabulary cost more than any piece and fall back to
their bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(codes: np.ndarray) -> np.ndarray:
    """Odd 64-bit numbers for character codes."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) * _ODD | np.uint64(1)


def default_model() -> str:
    """The public vocabulary with 32,000 pieces and byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """The pieces of a vocabulary, sorted by hash."""

    texts: list[str]
    scores: np.ndarray
    bytes_: np.ndarray  # id of each byte's piece
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        plain = [i for i, t in enumerate(self.texts) if t]
        self.longest = max((len(self.texts[i]) for i in plain), default=1)
        hashes = np.array([self.hash_of(self.texts[i]) for i in plain], dtype=np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(plain, dtype=np.int64)[order]
        self.lengths = {len(self.texts[i]) for i in plain}
        self.unknown = float(self.scores[plain].min()) - 10.0 if plain else -10.0
        # most substrings are no pieces; a table of hash bits says so before the search
        self.may = np.zeros(1 << 22, dtype=bool)
        self.may[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.raw = [t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in self.texts]  # what each id stands for
        for b, i in enumerate(self.bytes_.tolist()):
            self.raw[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)]
        texts = [model.id_to_piece(i) if ok else "" for i, ok in enumerate(plain)]
        scores = np.array([model.get_score(i) for i in range(n)])
        return cls(texts, scores, np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]))

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in _spread(np.array([ord(x) for x in text], dtype=np.uint64)).tolist():
            h = (h * int(_ODD) + c) % 2**64
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash's piece, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.may[(hashes >> np.uint64(42)).astype(np.int64)])
        if len(some):
            wanted = hashes[some]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == wanted, self.ids[at], -1)
        return out

    def best_paths(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of the best path of each chunk; all chunks have one length."""
        size, count = len(chunks[0]), len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(count, size)
        spread = _spread(codes)
        with np.errstate(over="ignore"):
            run = np.zeros((size + 1, count), dtype=np.uint64)
            for i in range(size):
                run[i + 1] = run[i] * _ODD + spread[:, i]
            powers = np.ones(self.longest + 1, dtype=np.uint64)
            for i in range(self.longest):
                powers[i + 1] = powers[i] * _ODD
            score = np.zeros((size + 1, count))
            back = np.ones((size + 1, count), dtype=np.int32)
            piece = np.full((size + 1, count), -1, dtype=np.int64)
            for end in range(1, size + 1):
                best = np.full(count, -np.inf)
                for length in sorted((n for n in self.lengths | {1} if n <= end), reverse=True):
                    ids = self.find(run[end] - run[end - length] * powers[length])
                    value = np.where(ids >= 0, self.scores[ids], self.unknown if length == 1 else -np.inf) + score[end - length]
                    better = value > best
                    best = np.where(better, value, best)
                    back[end] = np.where(better, length, back[end])
                    piece[end] = np.where(better, ids, piece[end])
                score[end] = best
        return self._follow(codes, back, piece)

    def _matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, lengths, ids) of every piece at every place, by end, the longest first."""
        size = len(codes)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_ODD, np.uint64(pow(int(_ODD), -1, 2**64))))
            run = np.concatenate([[np.uint64(0)], np.cumsum(_spread(codes) * down[:size], dtype=np.uint64)])
            found = []
            for length in sorted((n for n in self.lengths if n <= size), reverse=True):
                ends = np.arange(length, size + 1)
                ids = self.find((run[ends] - run[ends - length]) * up[ends - 1])
                some = ids >= 0
                found.append((ends[some], np.full(int(some.sum()), length), ids[some]))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        ends, lengths, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        return ends[order], lengths[order], ids[order]

    def path_by_matches(self, chunk: str, block: int = 1 << 18) -> np.ndarray:
        """The ids of the best path of one chunk, as best_paths gives them; the pieces of `block` places are found at a time."""
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = len(codes)
        score, back, piece = [0.0] * (size + 1), [1] * (size + 1), [-1] * (size + 1)
        for low in range(0, size, block):
            high, start = min(size, low + block), max(0, low - self.longest + 1)
            ends, lengths, ids = self._matches(codes[start:high])
            own = ends + start > low
            stop, lens, names = (ends[own] + start).tolist(), lengths[own].tolist(), ids[own].tolist()
            worth = self.scores[ids[own]].tolist()
            at, many = 0, len(stop)
            for end in range(low + 1, high + 1):
                best, length, name, single = -np.inf, 1, -1, False
                while at < many and stop[at] == end:
                    single = lens[at] == 1
                    if (value := worth[at] + score[end - lens[at]]) > best:
                        best, length, name = value, lens[at], names[at]
                    at += 1
                if not single and (value := self.unknown + score[end - 1]) > best:
                    best, length, name = value, 1, -1
                score[end], back[end], piece[end] = best, length, name
        out: list[int] = []
        end = size
        while end:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend(self.bytes_[list(chr(codes[end - 1]).encode("utf-8", "surrogatepass"))].tolist()[::-1])
            end -= back[end]
        return np.array(out[::-1], dtype=np.int32)

    def _follow(self, codes: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        count, size = codes.shape
        row, at = np.arange(count), np.full(count, size)
        rows, ids, last = [], [], []
        while len(row):
            a = at[row]
            rows.append(row)
            ids.append(piece[a, row])
            last.append(codes[row, a - 1])
            at[row] = a - back[a, row]
            row = row[at[row] > 0]
        # steps run from the end of each chunk: turned round, and sorted by chunk alone, they run from its start
        rows, ids, last = (np.concatenate(x[::-1]) for x in (rows, ids, last))
        order = np.argsort(rows, kind="stable")
        ids, last = ids[order].astype(np.int32), last[order]
        ends = np.cumsum(np.bincount(rows, minlength=count)).tolist()
        found = [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        for r in np.unique(rows[order][ids < 0]).tolist():
            i, j = ends[r - 1] if r else 0, ends[r]
            found[r] = np.concatenate([[p] if p >= 0 else self.bytes_[list(chr(x).encode("utf-8", "surrogatepass"))] for p, x in zip(ids[i:j].tolist(), last[i:j].tolist(), strict=True)]).astype(np.int32)
        return found


class Encoder:
    """Encodes texts; keeps the ids of chunks it has met, up to `room` short ones."""

    def __init__(self, pieces: Pieces, room: int = 300_000, cells: int = 1 << 21):
        self.pieces, self.room, self.cells = pieces, room, cells
        self.mark = pieces.bytes_[list(MARK.encode())].astype(np.int32).tobytes()
        self.kept: dict[str | None, bytes] = {None: self.mark}  # None stands for a mark of the text itself

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        for c in chunks:
            by_size.setdefault(len(c), []).append(c)
        found: dict[str, bytes] = {}
        for size, some in sorted(by_size.items()):
            if size > 32 and len(some) < 8:
                found.update((c, self.pieces.path_by_matches(c).tobytes()) for c in some)
                continue
            step = max(1, self.cells // (size + 1))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                found.update(zip(part, (x.tobytes() for x in self.pieces.best_paths(part)), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none, and so has an empty one.

        A mark that stands in the text itself is no space: it goes by its bytes.
        """
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif MARK in text:
                parts: list[str] = []
                for i, plain in enumerate((" " + text).split(MARK)):
                    parts += ([None] if i else []) + _CHUNK.findall(plain.replace(" ", MARK))
                cut.append(parts)
            else:
                cut.append(_CHUNK.findall(MARK + text.replace(" ", MARK)))
        kept = self.kept
        new = self.learn({c for parts in cut for c in parts}.difference(kept))
        if len(kept) + len(new) > self.room:
            kept.clear()
            kept[None] = self.mark
            new = self.learn({c for parts in cut for c in parts}.difference(kept))
        kept.update(new)
        out = [np.frombuffer(b"".join(map(kept.__getitem__, parts)), dtype=np.int32) for parts in cut]
        for c in new:
            if len(c) > 24:
                del kept[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text whose ids these are."""
        text = b"".join(map(self.pieces.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(Pieces.load(path))
    return _ENCODERS[path]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, texts_at_once: int = 256) -> DataFrame:
    """(key, ids) of every row; see Encoder.encode. Repeated rows come back as often.

    Other columns are left aside, and an empty table gives an empty one.
    """
    path = model or default_model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(i, texts_at_once)
                ids = own.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = docs.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, F.col(text).cast("string")).mapInArrow(of, schema).withColumnRenamed("key", key)


def decoded(ids: Column, model: str | None = None) -> Column:
    """The text of an array of ids."""
    path = model or default_model()

    @F.pandas_udf(T.StringType())
    def of(rows: pd.Series) -> pd.Series:
        own = encoder(path)
        return rows.map(lambda x: None if x is None else own.decode(np.asarray(x)))

    return of(ids)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = default_model()

    @F.pandas_udf(T.StructType([T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_crc32", T.LongType())]))
    def digest(rows: pd.Series) -> pd.DataFrame:
        own = encoder(path)
        ids = [np.asarray(x, dtype="<u4") for x in rows]
        return pd.DataFrame({"ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "decoded_crc32": [zlib.crc32(own.decode(x).encode("utf-8", "surrogatepass")) for x in ids]})

    done = encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest("ids").alias("d"))
    return done.select("doc_id", "n_ids", "d.ids_crc32", "d.decoded_crc32")
