"""Token ids of whole texts by the tokenizers library, exact and fast on text whose words repeat.

A byte-level BPE first cuts a text with a pattern, and no token crosses a cut. Some of its cuts show in two neighbouring characters alone:

* before a space, and on either side of a line end, that stands between two characters which are not white space,
* between a Latin letter and a sign of ASCII after it,
* between such a sign, unless it is an apostrophe (which may begin a contraction), and a Latin letter after it.

Texts are cut there, as bytes of an Arrow column, into units. Each worker has the library encode every unit that it does not remember, many in one
string, where a unit's ids end following from the tokens' lengths in bytes; units of more than LONG bytes are encoded each by itself. The memo
holds MEMO units, of which the half that was not seen for longest goes when it is full, so memory is bounded whatever the text. A unit is found by
a 64-bit hash and then compared byte for byte. Texts with an added token of the tokenizer in them go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import tidy
from .shingles import column_bytes, run_hashes

#: Units that the memo holds at most.
MEMO = 1_000_000
#: Bytes of text whose units are looked up at once.
CHUNK = 1_000_000
#: Bytes of text in one batch of results.
BATCH_BYTES = 8_000_000
#: The same for workers that must leave memory to others.
LEAN_MEMO, LEAN_CHUNK = 150_000, 250_000
#: Longer units are encoded but not remembered.
LONG = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True
_SIGN = _SOLID & ~_LETTER
_SIGN[48:58] = False
_SPLITS = _SIGN.copy()
_SPLITS[ord("'")] = False
#: First bytes of U+00C0 to U+023F, all of which are letters but for two.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xC9] = True
_PARTS = np.zeros(256, dtype=bool)
_PARTS[[32, 10]] = True


def _blank_at(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where the bytes a, b and, if it takes three, c are a white space character beyond ASCII."""
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _times(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where two bytes are a sign for multiplication or division."""
    return (b == 0xC3) & ((c == 0x97) | (c == 0xB7))


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start, ascending; no unit crosses the beginning of a row."""
    n = len(raw)
    start = np.zeros(n + 1, dtype=bool)
    start[offsets] = True
    if n > 2:
        at = lambda i: raw[np.clip(i, 0, n - 1)]
        p = np.flatnonzero(_PARTS[raw])
        p = p[(p > 0) & (p < n - 1)]
        p = p[~start[p] & ~start[p + 1]]
        b, c = raw[p - 1], raw[p + 1]
        before = _SOLID[b] | (b > 127) & ~_blank_at(at(p - 2), b, 0 * b) & ~_blank_at(at(p - 3), at(p - 2), b)
        after = _SOLID[c] | (c > 127) & ~_blank_at(c, at(p + 2), at(p + 3))
        p = p[before & after]
        start[p] = True
        start[p[raw[p] == 10] + 1] = True
        one, two = raw[:-1], raw[1:]
        sign = _SIGN[two]
        start[1:-1] |= _LETTER[one] & sign | _SPLITS[one] & _LETTER[two]
        q = np.flatnonzero(sign & (one > 127))
        start[q[_LEAD[at(q - 1)] & ~_times(at(q - 1), raw[q])] + 1] = True
        q = np.flatnonzero(_SPLITS[one] & _LEAD[two])
        start[q[~_times(raw[q + 1], at(q + 2))] + 1] = True
    start[n] = False
    return np.flatnonzero(start)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Held:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.empty(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            more = np.empty(max(self.n + len(x), len(self.all) * 3 // 2), self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def now(self) -> np.ndarray:
        return self.all[: self.n]


class WordEncoder:
    """Ids of texts as the library gives them with add_special_tokens=False; an added token in a text is that token, or with plain=True text like any other."""

    def __init__(self, path: str, memo: int | None = None, chunk: int | None = None, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # units come here once, so the library's own memo only costs
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one character of the vocabulary's alphabet stands for one byte
        self.added = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo, self.chunk = memo or MEMO, chunk or CHUNK
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending, and the place of each in what follows
        self.at, self.size, self.id_at, self.id_n, self.seen = (_Held(np.int64) for _ in range(5))
        self.bytes, self.ids = _Held(np.uint8), _Held(np.uint32)
        self.turn = 0

    def _halve(self) -> None:
        keep = np.flatnonzero(self.seen.now > np.median(self.seen.now))
        had, hashes = self.__dict__.copy(), np.empty(self.seen.n, np.uint64)
        hashes[self.entry] = self.hashes
        self._forget()
        self.turn = had["turn"]
        size, id_n = had["size"].now[keep], had["id_n"].now[keep]
        self._remember(hashes[keep], had["bytes"].now[ragged(had["at"].now[keep], size)], size, had["ids"].now[ragged(had["id_at"].now[keep], id_n)], id_n)

    def _remember(self, hashes, raw, size, ids, id_n) -> None:
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.entry = np.insert(self.hashes, place, hashes[order]), np.insert(self.entry, place, order + self.at.n)
        self.at.add(np.cumsum(size) - size + self.bytes.n)
        self.id_at.add(np.cumsum(id_n) - id_n + self.ids.n)
        self.size.add(size)
        self.id_n.add(id_n)
        self.seen.add(np.full(len(size), self.turn))
        self.bytes.add(raw)
        self.ids.add(ids)

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return unit_starts(raw, offsets)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _joined(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many of each). lead: 0 where each begins with a space, 1 to set a line end, a token of its own, before each."""
        counts, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(size), 20_000):
            n = size[lo : lo + 20_000]
            text = raw[ragged(starts[lo : lo + 20_000], n)]
            if lead:
                text = np.insert(text, np.cumsum(n) - n, 10)
            ids = self.whole([text.tobytes().decode("utf-8", "replace")])[0]
            ends, sizes = np.cumsum(self.n_bytes[ids]), np.cumsum(n + lead)
            last = np.minimum(np.searchsorted(ends, sizes) + 1, len(ids))
            if last[-1] != len(ids) or (ends[last - 1] != sizes).any():
                raise ValueError("the vocabulary joins words, so it is not the byte-level kind, or a text is not UTF-8")
            first = np.append(0, last[:-1])
            counts.append(last - first - lead)
            out.append(np.delete(ids, first) if lead else ids)
        return np.concatenate(out), np.concatenate(counts)

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        at = lambda i: raw[np.clip(i, 0, len(raw) - 1)]
        last = starts + size - 1
        opens = lambda i: _SOLID[at(i)] | (at(i) > 127) & ~_blank_at(at(i), at(i + 1), at(i + 2))
        closes = _SOLID[raw[last]] | (raw[last] > 127) & ~_blank_at(at(last - 1), raw[last], 0 * raw[last]) & ~_blank_at(at(last - 2), at(last - 1), raw[last])
        spaced, bare = (raw[starts] == 32) & (size > 1) & opens(starts + 1) & closes, opens(starts) & closes
        where = [np.flatnonzero(spaced), np.flatnonzero(bare), np.flatnonzero(~spaced & ~bare)]
        found = [self._joined(raw, starts[where[k]], size[where[k]], k) for k in (0, 1)]
        odd = self.whole([raw[starts[i] : starts[i] + size[i]].tobytes().decode("utf-8", "replace") for i in where[2]])
        found.append((np.concatenate([np.zeros(0, np.uint32), *odd]), np.array([len(x) for x in odd], dtype=np.int64)))
        order = np.concatenate(where)
        size = size[order]
        self._remember(hashes[order], raw[ragged(starts[order], size)], size, np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))

    def _units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit). raw holds these units and no more."""
        self.turn += 1
        size = ends - starts
        own = size > LONG
        short = np.flatnonzero(~own)
        h = run_hashes(raw, starts[short], ends[short])
        u, which = np.unique(h, return_inverse=True)
        new = np.ones(len(u), dtype=bool)
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
            new = self.hashes[near] != u
        if new.any():
            first = np.empty(len(u), dtype=np.int64)
            first[which[::-1]] = short[::-1]
            self._learn(u[new], raw, starts[first[new]], size[first[new]])
        entry = self.entry[np.searchsorted(self.hashes, u)]
        self.seen.now[entry] = self.turn
        entry = entry[which]
        # the same hash is not enough
        wrong = self.size.now[entry] != size[short]
        same = np.flatnonzero(~wrong)
        n = size[short[same]]
        other = self.bytes.now[ragged(self.at.now[entry[same]], n)] != raw[ragged(starts[short[same]], n)]
        if other.any():
            wrong[same[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(other), side="right"))]] = True
        own[short[wrong]] = True
        short, entry = short[~wrong], entry[~wrong]
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[short] = self.id_n.now[entry]
        ids = self.ids.now[ragged(self.id_at.now[entry], counts[short])]
        if own.any():
            alone = np.flatnonzero(own)
            found = self.whole([raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in alone])
            counts[alone] = [len(x) for x in found]
            to = np.cumsum(counts) - counts
            every = np.empty(counts.sum(), dtype=np.uint32)
            every[ragged(to[short], counts[short])] = ids
            for i, x in zip(alone, found):
                every[to[i] : to[i] + len(x)] = x
            ids = every
        if self.seen.n > self.memo:
            self._halve()
        return ids, counts

    def encode(self, column, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of an Arrow column of strings, the n + 1 offsets of the rows among them). end: an id after each row's."""
        raw, offsets = column_bytes(column)
        starts = self.cuts(raw, offsets)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        ids, counts, lo = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + self.chunk, side="right")))
            a, b = starts[lo], ends[hi - 1]
            x, n = self._units(raw[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
            ids.append(x)
            counts.append(n)
            lo = hi
        total = np.append(0, np.cumsum(np.concatenate(counts)))
        flat, at = np.concatenate(ids), total[np.searchsorted(starts, offsets)]
        flat, at = self._with_added(raw, offsets, flat, at)
        if end is not None:
            flat, at = np.insert(flat, at[1:], end), at + np.arange(len(at))
        return flat, at

    def _with_added(self, raw, offsets, flat, at) -> tuple[np.ndarray, np.ndarray]:
        """Rows in which the text of an added token stands, by the library."""
        text, rows = raw.tobytes(), set()
        for token in self.added:
            found = text.find(token)
            while found >= 0:
                row = int(np.searchsorted(offsets, found, side="right")) - 1
                if found + len(token) <= offsets[row + 1]:
                    rows.add(row)
                found = text.find(token, found + 1)
        if not rows:
            return flat, at
        parts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        for row in rows:
            parts[row] = self.whole([text[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")])[0]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


class PieceEncoder(WordEncoder):
    """Ids that a sentencepiece model gives for texts which begin with the space that it would add: piece(text[1:]).

    A text is cut where a run of spaces begins after another character. No piece of the vocabulary has a space after another character (that is
    checked), so no merge crosses such a cut. A unit whose pieces do not spell it, such as one with the model's own sign for a space, is UNLIKE.
    """

    UNLIKE = 0xFFFFFFFF

    def __init__(self, path: str, memo: int | None = None, chunk: int | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        if any(a != SPACE_SIGN and b == SPACE_SIGN for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("the model has pieces across words")
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in zip(ids, pieces)]
        self.n_bytes = np.array([len(x) for x in self.spelled], dtype=np.int64)
        self.alone = self.model.piece_to_id(SPACE_SIGN)
        self.added, self.memo, self.chunk = [], memo or MEMO, chunk or CHUNK
        self._forget()

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start = np.zeros(len(raw) + 1, dtype=bool)
        start[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
        start[offsets] = True
        start[-1] = False
        return np.flatnonzero(start)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text, ids in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []):
            ids = [self.alone] if text == " " else ids
            same = b"".join([self.spelled[i] for i in ids]) == text.encode()
            out.append(np.array(ids if same else [self.UNLIKE], dtype=np.uint32))
        return out

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        ids = self.whole([raw[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(starts, size)])
        self._remember(hashes, raw[ragged(starts, size)], size, np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], dtype=np.int64))


#: Fixed value: the character that stands for a space in a sentencepiece vocabulary.
SPACE_SIGN = "\u2581"

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that its memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_batches(batches, path: str, text_col: str, end_id: int, lean: bool = False):
    """(part of a batch, ids as unsigned 32-bit numbers, offsets of the rows among them). Ids are those of the text (null: empty), then end_id. lean: the
    memo is small, and is given up after the task, for workers that live on beside other stages."""
    enc = encoder(path)
    enc.memo, enc.chunk = (LEAN_MEMO, LEAN_CHUNK) if lean else (MEMO, CHUNK)
    for batch in batches:
        sizes = column_bytes(batch.column(text_col))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (BATCH_BYTES // 4 if lean else BATCH_BYTES), side="right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *enc.encode(part.column(text_col), end_id)
            at = to
    if lean:
        enc._forget()
    tidy()


def as_binary(ids: np.ndarray, offsets: np.ndarray):
    """An Arrow column of the ids as little-endian bytes."""
    import pyarrow as pa

    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
