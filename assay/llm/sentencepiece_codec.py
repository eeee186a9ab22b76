"""SentencePiece encoding and decoding with the byte span of every piece.

The normaliser is run here, piece of text by piece, the way the compiled character map of the
model asks for: at every place the longest prefix that the map holds is replaced, and each output
byte remembers the input byte it came from. The library merges the pieces; since they cover the
normalised bytes without a gap, their lengths give their borders, and the remembered alignment
projects the borders onto the bytes of the original text.

Edge cases: a null text is an empty one and gives the begin and end ids only; begin and end have
empty spans at the text's borders. Texts are never cut. Rows are independent, so repeated rows
and ties don't matter; other columns are kept, result columns replace those of the same names.
Columns of the caller may have any name; those named like a result column are replaced by it.
"""

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.names import hidden, shown
from assay.llm.workers import releasing

SPACE = "▁".encode()
REPLACEMENT = "�".encode()
#: Texts given to the library at once, in characters.
CHUNK_CHARS = 4 << 20


class CharsMap:
    """The compiled character map: a double-array trie of prefixes, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.texts = [], b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix at this place that the map holds, and its replacement."""
        if not self.units:
            return None
        found, units = None, self.units
        node = self._child_base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child_base(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    @staticmethod
    def _child_base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Codec:
    """A model with its normaliser settings."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else b" "
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = pb.ModelProto.SentencePiece
        self.width = np.array(
            [
                1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode())
                for p in model.pieces
            ]
        )
        self.unknown = np.array([p.type == kinds.UNKNOWN for p in model.pieces])

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and their end) the input byte it came from."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            return self._identity(data)
        out, source, at = bytearray(), [], 0
        if self.squeeze:
            at = len(data) - len(data.lstrip(b" "))
        if self.prefix and at < len(data):
            out += self.space
            source += [at] * len(self.space)
        spaced = self.squeeze
        while at < len(data):
            n, piece = self.map.longest(data, at) or (0, b"")
            if not n:
                n = _char_bytes(data[at])
                piece = data[at : at + n]
            if self.squeeze and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                for b in piece:
                    new = self.space if b == 0x20 else bytes([b])
                    out += new
                    source += [at] * len(new)
                spaced = piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), np.array([*source, len(data) if not self.squeeze else at], dtype=np.int64)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """With an empty map only spaces change, so the alignment is one repeat."""
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 0x20, len(self.space), 1)
        source = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
        out = data.replace(b" ", self.space)
        if self.prefix and data:
            out, source = self.space + out, np.append(np.zeros(len(self.space), np.int64), source)
        return out, source

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every piece in the original text."""
        normal, source = self.normalise(text)
        width = self.width[ids]
        if self.unknown[ids].any():
            # An unknown piece covers what the pieces of a second, textual encoding say.
            own = [len(p.encode()) for p in self.sp.encode(text, out_type=str)]
            width[width.nonzero()[0] if len(own) != len(ids) else slice(None)] = own
        border = np.concatenate([[0], np.cumsum(width)])
        if border[-1] != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return source[border[:-1]], source[border[1:]]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


RESULT = "ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, gaps long"


def _encoded(model: str, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, str]]:
    c = codec(model)
    for a, b in _chunks(texts):
        ids = c.sp.encode(texts[a:b], add_bos=True, add_eos=True, num_threads=1)
        back = c.sp.decode(ids, num_threads=1)
        for text, own, decoded in zip(texts[a:b], ids, back, strict=True):
            own = np.array(own, dtype=np.int32)
            yield (text, own, *c.spans(text, own), decoded)


def _run(df: DataFrame, text: str, schema: str, rows, kept: list[str]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kept = [c for c in kept if c not in names]
    rows_in, inner = hidden(df)
    inner, body = {c: inner[c] for c in kept}, inner[text]
    types = {f.name: f.dataType for f in rows_in.schema}
    out = ", ".join([*(f"{h} {types[h].simpleString()}" for h in inner.values()), schema])
    hid = list(inner.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = x["_text"].tolist()
            for a, b in _chunks(texts):
                made = pd.DataFrame(rows(texts[a:b]), columns=names)
                part = x[hid].iloc[a:b].reset_index(drop=True)
                yield pd.concat([part, made], axis=1)

    texts_in = rows_in.select(*hid, F.coalesce(body, F.lit("")).alias("_text"))
    return texts_in.mapInPandas(releasing(run), out).select(*shown(inner), *names)


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`df` with ids, starts and ends (original bytes of each piece) and the decoded text."""
    return _run(df, text, RESULT, lambda texts: [r[1:] for r in _encoded(model, texts)], df.columns)


def encode_digests(df: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the number and digest of the ids, that of the decoded text, and the
    number of original bytes that no piece's span covers (0 unless the model drops spaces)."""

    def rows(texts: list[str]) -> list[tuple]:
        out = []
        for text, ids, starts, ends, decoded in _encoded(model, texts):
            inside = ends > starts
            covered = int((ends[inside] - np.maximum(starts[inside], np.append(0, ends[inside][:-1]))).sum())
            out.append(
                (
                    len(ids),
                    hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                    len(text.encode()) - covered,
                )
            )
        return out

    return _run(df, text, DIGEST, rows, keep if keep is not None else df.columns)
