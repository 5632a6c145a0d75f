"""Whole-text encoding with the tokenizers library, one slice of an Arrow batch at a time.

Texts are cut at the vocabulary's added tokens, which the library takes out before anything else, and before the last
blank of a run of blanks; no pre-token reaches across such a cut, so a text's ids are the ids of its pieces in order. A
cut left out does no harm, so only ASCII blanks are cut at, and none beside what may be another kind of blank. Where the
vocabulary's own split is one of ``_SPLITS``, texts are also cut between letters up to U+00FF, ASCII digits and ASCII
marks, but not after an apostrophe and before a letter: far fewer pieces are distinct. Within a slice each distinct piece
is encoded once. Plain words go straight to the library's model, with what its normalizer and split make of each letter.
The pieces met most often are remembered by the worker for its next slices and tasks, in ``memory`` bytes at most.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: First bytes of the blanks outside ASCII (fixed by the Unicode property White_Space in UTF-8).
_WIDE_BLANKS = (0xC2, 0xE1, 0xE2, 0xE3)
_BLANK, _PLAIN = np.zeros(256, bool), np.ones(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_PLAIN[[*range(9, 14), 32, *_WIDE_BLANKS]] = False
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK = 3
_CLASS[ord("'")] = _APOSTROPHE = 4
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER = 1
_CLASS[48:58] = _DIGIT = 2
#: Second bytes of the letters from U+00C0 to U+00FF.
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d|"
#: Patterns of a vocabulary's split, and whether each digit stands alone.
_SPLITS = {
    _CONTRACTED + r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": False,
    _CONTRACTED + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": True,
}
_TOGETHER = 64
#: Words of letters up to U+00FF; longer ones take the library's whole way.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){1,64}").fullmatch
#: Bytes a remembered piece takes besides its characters and ids, about.
_ENTRY = 150


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _apart(tokenizer) -> np.ndarray | None:
    """For two classes of neighbouring characters whether the vocabulary always splits between them, or None."""
    split = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    steps = split.get("pretokenizers", [split])
    first = steps[0] if steps else {}
    if first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        pattern = next(iter(_SPLITS))  # the library's own
    elif first.get("type") == "Split" and (first["behavior"], first["invert"]) == ("Removed", True):
        pattern = first["pattern"].get("Regex")
    else:
        return None
    if pattern not in _SPLITS or any(x["type"] != "ByteLevel" or x["use_regex"] or x["add_prefix_space"] for x in steps[1:]):
        return None
    found = np.zeros((8, 8), bool)
    found[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = found[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = True
    found[_MARK, [_LETTER, _DIGIT]] = found[_APOSTROPHE, _DIGIT] = True
    found[_DIGIT, _DIGIT] = _SPLITS[pattern]
    return found.ravel()


def _forms(tokenizer) -> dict[int, str] | None:
    """What the model gets for each letter of ``_WORD`` and for the blank before them; None where a normalizer may do more
    than change letters one by one."""
    normalizer = json.loads(tokenizer.to_str())["normalizer"]
    steps = normalizer.get("normalizers", [normalizer]) if normalizer else []
    if any(x["type"] not in ("NFC", "Lowercase") and (x["type"], x.get("pattern"), x.get("content")) != ("Replace", {"Regex": r"\s+"}, " ") for x in steps):
        return None
    seen = lambda text: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text) if normalizer else text))
    return {32: seen(" a").removesuffix("a")} | {i: seen(chr(i)) for i in range(256) if _WORD(chr(i).encode())}


class PieceEncoder:
    """Encodes texts to flat ids."""

    def __init__(self, path: str, memory: int = 48 << 20):
        self.tokenizer, self.memory = _tokenizer(path), memory
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.apart, self.model = _apart(self.tokenizer), self.tokenizer.model
        self.forms = None if self.apart is None else _forms(self.tokenizer)
        self.at_added = re.compile(b"|".join(map(re.escape, self.added)))
        # stands between pieces that are encoded together; no piece holds it, and none can complete it
        self.between, self.mark = next((t.decode(), i) for t, i in self.added.items() if b"<" not in t[1:])
        self.known: dict[bytes, int] = {}
        self.bounds, self.ids, self.hits = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces start in texts laid end to end, and the end of the last."""
        found = np.zeros(len(data) + 1, bool)
        if len(data):
            found[: len(data) - 1] = _BLANK[data[:-1]] & _PLAIN[data[1:]]
            if self.apart is not None:
                kinds = _CLASS[data]
                two = np.flatnonzero((data[:-1] == 0xC3) & _AFTER_C3[data[1:]])
                kinds[two] = kinds[two + 1] = _LETTER
                found[1 : len(data)] |= self.apart[kinds[:-1] << 3 | kinds[1:]]
        found[np.maximum(bounds, 1) - 1] = False  # the last byte of a text has no next
        raw = data.tobytes()
        spans = [m.span() for m in self.at_added.finditer(raw)] if b"<|" in raw else []
        spans = [(i, j) for i, j in spans if j <= bounds[np.searchsorted(bounds, i, "right")]]  # not across two texts
        for i, j in spans:
            found[i + 1 : j] = False
            found[i - 1] = False  # the blanks before an added token end a stretch of their own
        for i, j in spans:
            found[[i, j]] = True
        found[bounds] = True
        return np.flatnonzero(found)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (one more than pieces) and flat ids."""
        words = np.array([self.forms is not None and _WORD(p) is not None and p not in self.added for p in pieces], bool)
        others = [p for p, w in zip(pieces, words.tolist(), strict=True) if not w]
        plain = [p.decode() for p in others if p not in self.added]
        joined = [self.between.join([*plain[i : i + _TOGETHER], ""]) for i in range(0, len(plain), _TOGETHER)]
        coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in coded), np.int64)
        stops = np.flatnonzero(flat == self.mark)
        lengths, own = np.ones(len(pieces), np.int64), np.array([p not in self.added for p in pieces], bool)
        lengths[own & ~words] = np.diff(stops, prepend=-1) - 1
        straight = [[t.id for t in self.model.tokenize(p.decode().translate(self.forms))] for p, w in zip(pieces, words.tolist(), strict=True) if w]
        lengths[words] = np.fromiter(map(len, straight), np.int64, len(straight))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(bounds[-1], np.uint32)
        out[np.repeat(own & ~words, lengths)] = flat[flat != self.mark]
        out[np.repeat(words, lengths)] = np.fromiter(chain.from_iterable(straight), np.int64)
        out[np.repeat(~own, lengths)] = [self.added[pieces[i]] for i in np.flatnonzero(~own).tolist()]
        return bounds, out

    def _trim(self) -> None:
        """Forgets the pieces met least often once the remembered ones take more than ``memory`` bytes."""
        sizes = np.fromiter(map(len, self.known), np.int64, len(self.known)) + _ENTRY + 4 * np.diff(self.bounds)
        if sizes.sum() <= self.memory:
            return
        order = np.argsort(-self.hits, kind="stable")
        kept = np.zeros(len(order), bool)
        kept[order[np.cumsum(sizes[order]) <= self.memory // 2]] = True
        pieces = [p for p, k in zip(self.known, kept.tolist(), strict=True) if k]
        lengths = np.diff(self.bounds)
        self.ids = self.ids[np.repeat(kept, lengths)]
        self.bounds = np.concatenate([[0], np.cumsum(lengths[kept])])
        self.hits = self.hits[kept] // 2
        self.known = dict(zip(pieces, range(len(pieces)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (one more than texts) and flat ids, ``end_id`` after every text. Null texts are empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.zeros(0, np.uint8)
        places = places - places[0]
        starts = self.cuts(data, places)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        counts = np.diff(np.searchsorted(starts, places))

        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        slot = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        slot[new] = len(self.known) + np.arange(len(new))
        fresh = [distinct[i] for i in new.tolist()]
        bounds, ids = self._learn(fresh)
        self.known.update(zip(fresh, slot[new].tolist(), strict=True))
        self.bounds, self.ids = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]]), np.concatenate([self.ids, ids])
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[slot] += np.bincount(codes, minlength=len(distinct))

        # one more "piece" per text, of one id, carries the end id
        last, slots = np.cumsum(counts), slot[codes]
        starts, stops = np.insert(self.bounds[slots], last, -1), np.insert(self.bounds[slots + 1], last, 0)
        lengths = stops - starts
        ends = np.cumsum(lengths)
        flat = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        out = np.append(self.ids, np.uint32(end_id))[flat]
        self._trim()
        return np.concatenate([[0], ends[last + np.arange(len(texts))]]).astype(np.int64), out


@cache
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    return PieceEncoder(path)
