"""Token counts of whole texts; neither ids nor texts leave the tasks.

Texts of an Arrow batch are laid end to end and worked off in windows of about ``window`` bytes. A window ends at a safe
boundary, where no token reaches across, so short texts share a window and a long one is split over several. Within a
window each distinct piece between safe boundaries is encoded once, and lengths of pieces are remembered by the worker for
later windows and tasks, in about ``memory`` bytes.

Safe boundaries: for ``.json`` vocabularies those of ``tokens.PieceEncoder``; for ``.model`` vocabularies a blank after an
ASCII letter, digit or mark. There no token has a blank after another character (checked when the file is read), and the
blank that the library puts before a text stands for the one cut away.

Null and empty texts have no tokens; very long texts are counted whole; null ``doc_id`` stay null; every repeated row gets
a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import own, read
from .tokens import PieceEncoder

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes a remembered piece takes besides its characters, about.
_ENTRY = 120
#: Bytes at a window's end that are left to the next: an added token may be cut off there.
_GUARD = 64


class JsonPieces:
    """Pieces of a vocabulary of the tokenizers library; its added tokens count one each."""

    def __init__(self, path: str):
        self.encoder = PieceEncoder(path)
        self.cuts = self.encoder.cuts

    def measure(self, pieces: list[bytes], first: np.ndarray) -> np.ndarray:
        return np.diff(self.encoder._learn(pieces)[0])


class ModelPieces:
    """Pieces of a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a token of this vocabulary holds a blank after another character; texts cannot be split")

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        found = np.zeros(len(data) + 1, bool)
        found[1 : len(data)] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
        found[np.maximum(bounds, 1) - 1] = False  # the last byte of a text stays with those before it
        found[bounds] = True
        return np.flatnonzero(found)

    def measure(self, pieces: list[bytes], first: np.ndarray) -> np.ndarray:
        """``first``: whether a piece begins its text; the others' blank is the one the library adds."""
        texts = [(p if own_start else p[1:]).decode() for p, own_start in zip(pieces, first.tolist(), strict=True)]
        return np.fromiter(map(len, self.model.encode(texts, num_threads=1)) if texts else (), np.int64, len(texts))


class Counter:
    """Counts tokens of texts. The lengths remembered lie in two halves; the older is forgotten when the newer is full."""

    def __init__(self, path: str, memory: int = 48 << 20):
        self.pieces = (ModelPieces if path.endswith(".model") else JsonPieces)(path)
        self.memory, self.size = memory, 0
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _windows(self, data: np.ndarray, places: np.ndarray, window: int):
        """Starts of pieces, and the end of the last, window by window."""
        start = 0
        while start < len(data):
            width = window
            while True:
                end = min(start + width, len(data))
                inside = places[np.searchsorted(places, start, "right") : np.searchsorted(places, end, "left")]
                cuts = self.pieces.cuts(data[start:end], np.concatenate([[0], inside - start, [end - start]]))
                if end == len(data):
                    break
                cuts = cuts[cuts <= width - _GUARD]
                if len(cuts) > 1:
                    break
                width *= 2  # no safe boundary so far
            yield start + cuts
            start += int(cuts[-1])

    def _lengths(self, distinct: list[bytes]) -> np.ndarray:
        out = np.fromiter((self.new.get(p, -1) for p in distinct), np.int64, len(distinct))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.old.get(distinct[i], -1)
        missing = np.flatnonzero(out < 0).tolist()
        fresh = [distinct[i] for i in missing]
        out[missing] = self.pieces.measure(fresh, np.array([p[:1] != b" " for p in fresh], bool))
        self.new.update(zip(distinct, out.tolist(), strict=True))
        self.size += sum(map(len, fresh)) + _ENTRY * len(fresh)
        if self.size > self.memory // 2:
            self.old, self.new, self.size = self.new, {}, 0
        return out

    def count(self, texts: pa.Array, window: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text; null texts are empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.zeros(0, np.uint8)
        places = places - places[0]
        tokens = np.zeros(len(texts), np.int64)
        for starts in self._windows(data, places, window):
            part = data[starts[0] : starts[-1]]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts - starts[0]), pa.py_buffer(part)]).dictionary_encode()
            lengths = self._lengths(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy(zero_copy_only=False)]
            text = np.searchsorted(places, starts[:-1], "right") - 1
            if isinstance(self.pieces, ModelPieces):  # a text's own first blank is not the one the library adds
                for i in np.flatnonzero((places[text] == starts[:-1]) & (data[starts[:-1]] == 32)).tolist():
                    lengths[i] = self.pieces.measure([data[starts[i] : starts[i + 1]].tobytes()], np.ones(1, bool))[0]
            np.add.at(tokens, text, lengths)
        return np.diff(places), tokens


@cache
def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, window: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``vocabulary`` is a ``.json`` or ``.model`` file."""

    def count(batches):
        known = counter(vocabulary)
        for batch in batches:
            sizes, tokens = known.count(batch.column(1), window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return own(docs, "doc_id", "text").mapInArrow(count, COUNTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
