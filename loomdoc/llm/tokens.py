"""Token ids by the tokenizers library, with the work of repeated words saved.

``WordIds`` gives the same ids as ``Tokenizer.encode`` over whole texts. It cuts
a text where the tokenizer's own pre-tokenizer surely cuts, at a single space
between two words, and remembers each piece's ids. A small memory has two
generations, of which the elder goes when the younger is full, so words that are
met again stay; in a large one they are learned again so seldom that this is
cheaper. Pieces of plain letters go to the library's BPE model itself, other
pieces to its whole tokenizer, and a text whose white space isn't that plain goes
to the whole tokenizer at once, as does one that holds an added token's string.
``encode_all`` takes texts some megabytes at a time and looks up each different
word of those once. Where a tokenizer drops white space, it remembers words as
above. A byte-level tokenizer that keeps white space is followed in arrays: texts
are cut before white space as its pattern cuts them, different words by classes
of characters, and the merges go through all different pieces at once
(``Merges``), which costs less than remembering them, so nothing grows with the
input but what words of rarer characters need.

By default a special token's string in a text is that token, as the library has
it; with ``specials_as_text`` it is ordinary text, so that no document can forge
a document's end.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters below this are in no need of Unicode normalisation.
PLAIN_END = "ɐ"
#: Words a worker remembers, about 200 bytes each, and those of one text or slice more.
CACHE_WORDS = 1_200_000
#: A memory of fewer words than this has two generations.
AGES_BELOW = 500_000
TAIL = frozenset(".,;:!?")
#: Of what drops white space, a run of these at a word's end is a piece of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Bytes of the texts that encode_all takes at a time, and where pieces aren't remembered.
SLICE_BYTES = 4 << 20
ARRAY_BYTES = 8 << 20
#: Merges takes pieces of up to this many bytes, and of a length that so many pieces have at least; the model takes the others.
LONGEST = 48
FEWEST = 24
#: White space to Python and not to the tokenizers.
ODD_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
ODD_SPACES = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What Merges can follow: byte-level BPE over GPT-2's pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SPACE, LETTER, DIGIT, MARK, UNSURE = range(5)
CLASSES = np.array([SPACE if b in b" \t\n\v\f\r" else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK if 32 < b < 127 and b != 39 else UNSURE for b in range(128)] + [UNSURE] * 128, np.uint8)
IS_SPACE = CLASSES == SPACE


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others get U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def compact(texts: pa.Array) -> tuple[pa.StringArray, bytes]:
    """The texts as an array whose bytes begin at 0, as Arrow's functions err on some slices; and those bytes."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    off = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1]
    data = data[int(off[0]) : int(off[-1])] if data else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((off - off[0]).astype(np.int32)), data), data.to_pybytes()


def spans(off: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places off[i] to off[i + 1] of each number i, one after another, and where each number's end."""
    begin = off[numbers]
    n = off[numbers + 1] - begin
    ends = np.cumsum(n)
    at = np.repeat(begin - (ends - n), n)
    at += np.arange(len(at))
    return at, ends


def parts(words: pa.StringArray) -> list[pa.StringArray]:
    """Words without the marks at their ends, and those marks; a word whose stem doesn't surely end in a letter or digit stays whole."""
    stems = pc.ascii_rtrim(words, characters=MARKS)
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(2, np.uint8))
    cut = off[:-1] + pc.binary_length(stems).to_numpy()
    last, before = data[cut - 1], data[cut - 2]
    sure = (cut > off[:-1]) & (ALNUM[last] | (before == 0xC3) & (last >= 0x9F) & (last != 0xB7))  # ASCII, or ß to ÿ without ÷
    sizes = np.where(sure, off[1:] - cut, 0)
    at, ends = spans(np.stack((cut, cut + sizes), 1).ravel(), np.arange(0, 2 * len(words), 2))
    marks = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[at]))
    return [pc.if_else(pa.array(sure), stems, words), marks]


def strings(begins: np.ndarray, data: pa.Buffer | None) -> pa.StringArray:
    """data cut at begins, of which the last is its end."""
    return pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int32)), data or pa.py_buffer(b""))


def cut_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words begin in texts data[off[i]:off[i + 1]], and the end: before the last of a run of white space if a word follows it,
    before a run otherwise. GPT-2's pattern surely cuts there, whatever stands around."""
    space = IS_SPACE[data]
    last = np.empty(len(data), bool)  # no space after it in its text
    last[:-1] = ~space[1:]
    last[off[1:][off[1:] > 0] - 1] = False
    begin = np.ones(len(data), bool)
    begin[1:] = space[1:] & (~space[:-1] | last[1:])
    begin[off[:-1][off[:-1] < len(data)]] = True
    return np.append(np.flatnonzero(begin), len(data))


def cut_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of words begin, and the end; and the numbers of words in which that isn't sure. A space goes with what is after it."""
    kind = CLASSES[data]
    wide = np.flatnonzero(data >= 128)
    if len(wide):
        lead = data[wide]
        after = data[np.minimum(wide + 1, len(data) - 1)]
        # U+00C0 to U+024F but × and ÷
        letter = (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) | (lead == 0xC9) & (after <= 0x8F)
        kind[wide[letter]] = LETTER
        kind[wide[letter] + 1] = LETTER
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) & (data[:-1] != 32)
    begin[off[:-1]] = True
    unsure = np.unique(np.searchsorted(off, np.flatnonzero(kind == UNSURE), "right") - 1)
    return np.append(np.flatnonzero(begin), len(data)), unsure


class Merges:
    """Byte-level BPE over many pieces at once: in each round every piece merges its pair of the lowest rank, the leftmost of those."""

    def __init__(self, model: dict, merges: list[tuple[str, str]], letters: dict[int, str]):
        vocab = model["vocab"]
        self.ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        ranks = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(merges)}
        self.wide = max(vocab.values()) + 1
        self.none = len(merges)
        self.made = np.zeros(len(merges) + 1, np.int64)
        pairs = np.array(list(ranks), np.int64).reshape(-1, 2)
        values = np.array(list(ranks.values()), np.int64).reshape(-1, 2)
        self.made[values[:, 0]] = values[:, 1]
        codes = pairs[:, 0] * self.wide + pairs[:, 1]
        bits = max(8, (16 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        # open addressing; a row of misses may run beyond the end
        self.codes = np.full((1 << bits) + len(codes) + 1, -1, np.int64)
        self.ranks = np.full(len(self.codes), self.none, np.int32)
        left, at = np.arange(len(codes)), self._slots(codes)
        while len(left):
            free = self.codes[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.codes[slot], self.ranks[slot] = codes[left[placed]], values[left[placed], 0]
            stay = np.ones(len(left), bool)
            stay[placed] = False
            left, at = left[stay], at[stay] + 1
        b = np.arange(256)
        self.first = self._rank(np.repeat(self.ids[b], 256), np.tile(self.ids[b], 256))

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, or none."""
        codes = left * self.wide + right
        at = self._slots(codes)
        found = self.codes[at]
        out = self.ranks[at]
        rest = np.flatnonzero((found != codes) & (found >= 0))
        out[found < 0] = self.none
        while len(rest):
            at[rest] += 1
            found = self.codes[at[rest]]
            hit = found == codes[rest]
            out[rest] = np.where(hit, self.ranks[at[rest]], self.none)
            rest = rest[~hit & (found >= 0)]
        return out

    def group(self, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """raw has a piece's bytes in each column. (columns, their ids in columns) of pieces with as many ids each."""
        out = []
        columns, symbols = np.arange(raw.shape[1]), self.ids[raw]
        ranks = self.first[raw[:-1].astype(np.int64) << 8 | raw[1:]] if len(raw) > 1 else np.zeros((0, raw.shape[1]), np.int32)
        while len(ranks):
            best = ranks[0] << 6
            for k in range(1, len(ranks)):
                np.minimum(best, ranks[k] << 6 | k, out=best)
            go = best < self.none << 6
            if not go.all():
                done = np.flatnonzero(~go)
                out.append((columns[done], symbols[:, done]))
                go = np.flatnonzero(go)
                if not len(go):
                    return out
                columns, symbols, ranks, best = columns[go], symbols[:, go], ranks[:, go], best[go]
            pos, new, n = best & 63, self.made[best >> 6], np.arange(len(columns))
            for k in range(len(ranks)):
                np.copyto(symbols[k], symbols[k + 1], where=pos < k)
                if k + 1 < len(ranks):
                    np.copyto(ranks[k], ranks[k + 1], where=pos <= k)
            symbols, ranks = symbols[:-1], ranks[:-1]
            symbols[pos, n] = new
            has = np.flatnonzero(pos > 0)
            ranks[pos[has] - 1, has] = self._rank(symbols[pos[has] - 1, has], new[has])
            has = np.flatnonzero(pos < len(ranks))
            ranks[pos[has], has] = self._rank(new[has], symbols[pos[has] + 1, has])
        return [*out, (columns, symbols)]


class WordIds(dict):
    """Word -> its number; the ids of number i are flat[off[i]:off[i + 1]]."""

    def __init__(self, path: str, max_words: int = CACHE_WORDS, specials_as_text: bool = False):
        super().__init__()
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        extra = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
        self.bpe = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **extra)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = specials_as_text
        added = [t for t in spec.get("added_tokens") or [] if not (specials_as_text and t["special"])]
        self.added = [t["content"] for t in added if not t["normalized"]]
        self.added_folded = [t["content"].lower() for t in added if t["normalized"]]  # these are looked for after normalisation
        self.spaced = not spec.get("normalizer")  # a piece keeps the space before it; else white space is dropped and case is folded
        self.letters = byte_letters()
        self.space = self.letters[32] if self.spaced else ""
        self.tails = {c: self._plain(c) for c in TAIL}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        pattern = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in BYTE_LEVEL}
        every = all(c in model["vocab"] for c in self.letters.values())
        self.merges = Merges(model, merges, self.letters) if self.spaced and plain and every and pattern == BYTE_LEVEL and not self.added_folded else None
        self.max_words, self.ages = max_words, max_words < AGES_BELOW
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.off = array("I"), array("q", [0])
        self.elder: tuple[dict[str, int], array, array] = ({}, self.flat, self.off)
        self.firsts: dict[str, np.ndarray] = {}  # words that begin a text, without a space before them
        self.others: dict[str, np.ndarray] = {}  # words that arrays can't cut

    def _plain(self, word: str, space: str = "") -> list[int]:
        """The model's ids of a piece in its own letters; ASCII letters and marks stand for themselves."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.bpe.tokenize(space + letters)]

    def _ids(self, word: str) -> list[int] | None:
        """None: the text must go to the whole tokenizer."""
        if self.spaced:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            if word.isalpha() and (word.isascii() or max(word) < PLAIN_END):
                return self._plain(word, self.space)
            if word[-1] in TAIL and word[:-1].isalpha() and (word.isascii() or max(word) < PLAIN_END):
                return self._of(word[:-1]) + self.tails[word[-1]]
            return self.whole.encode(f" {word}", add_special_tokens=False).ids
        low = word.lower()
        stem = low.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) < PLAIN_END):
            return self._plain(low) if len(stem) == len(low) else self._of(stem) + self._of(low[len(stem) :])
        return self.whole.encode(word, add_special_tokens=False).ids

    def _of(self, word: str) -> list[int]:
        i = self[word]
        return self.flat[self.off[i] : self.off[i + 1]].tolist()

    def __missing__(self, word: str) -> int:
        known, flat, off = self.elder
        i = known.get(word) if known else None
        ids = self._ids(word) if i is None else flat[off[i] : off[i + 1]] if i >= 0 else None
        if ids is None:
            self[word] = -1
            return -1
        self.flat.extend(ids)
        self.off.append(len(self.flat))
        self[word] = n = len(self.off) - 2
        return n

    def _numbers(self, words: list[str]) -> np.ndarray:
        """self[word] of each; words differ and white space is dropped."""
        numbers = list(map(self.get, words))
        for i, word in enumerate(words):
            if numbers[i] is not None:
                continue
            low = word.lower()
            if low.isascii() and low.isalpha():
                self.flat.extend([t.id for t in self.bpe.tokenize(low)])
                self.off.append(len(self.flat))
                self[word] = numbers[i] = len(self.off) - 2
            else:
                numbers[i] = self[word]
        return np.array(numbers, np.int64)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one after another, and where each word's end."""
        off = np.frombuffer(self.off, dtype=np.int64)
        flat = np.frombuffer(self.flat, dtype=np.uint32) if self.flat else np.zeros(0, np.uint32)
        at, ends = spans(off, numbers)
        return flat[at], ends

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        if any(a in text for a in self.added) or self.added_folded and any(a in text.lower() for a in self.added_folded):
            return self._all(text)
        self._make_room()
        if self.spaced:
            first, *rest = text.split(" ")
            if not first or first[0].isspace() or first[-1].isspace():
                return self._all(text)
        else:
            if any(c in text for c in ODD_CONTROLS):
                return self._all(text)
            # ASCII is folded at once, so a word is known however it was written, unless that makes an added token's string
            low = text.lower() if text.isascii() else text
            first, rest = "", (text if any(a in low for a in self.added) else low).split()
        numbers = np.fromiter(map(self.__getitem__, rest), np.int64, len(rest))
        if len(numbers) and numbers.min() < 0:
            return self._all(text)
        ids = self._gather(numbers)[0]
        if not first:
            return ids
        begin = self.firsts.get(first)
        if begin is None:
            begin = self.firsts[first] = self._all(first)
        return np.concatenate([begin, ids])

    def _make_room(self) -> None:
        if len(self) > self.max_words // (1 + self.ages):
            elder = (dict(self), self.flat, self.off) if self.ages else None
            self.forget()
            if elder:
                self.elder = elder

    def encode_all(self, texts: pa.Array, slice_bytes: int | None = None) -> Iterator[np.ndarray]:
        """What encode gives for each text, in their order; a null is empty."""
        texts = texts.fill_null("")
        if not self.merges and (self.spaced or self.added_folded):
            yield from map(self.encode, texts.to_pylist())
            return
        slice_bytes = slice_bytes or (ARRAY_BYTES if self.merges else SLICE_BYTES)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + slice_bytes, "right")))
            yield from (self._arrays if self.merges else self._slice)(texts[begin:end])
            begin = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self._make_room()
        texts, every = compact(texts)
        low = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        # texts that encode takes another way; a search through all of them at once is much cheaper than one in each
        every += compact(low)[1]
        rare = [a for a in (*self.added, *ODD_CONTROLS) if a.encode() in every]
        odd = reduce(pc.or_, [pc.match_substring(t, a) for a in rare for t in (texts, low)], pa.repeat(False, len(texts)))
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", low))
        coded = words.flatten().dictionary_encode()
        n = len(coded.dictionary)
        pieces = pa.concat_arrays(parts(coded.dictionary)).dictionary_encode()
        # pieces hold no white space, so all may come to Python as one string
        known = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary), "\n")[0].as_py().split("\n")
        numbers = self._numbers(known)[pieces.indices.to_numpy()]
        flat, ends = self._gather(np.stack((numbers[:n], numbers[n:]), 1).ravel())
        at, ends = spans(np.concatenate([[0], ends[1::2]]), coded.indices.to_numpy())
        ids = flat[at]
        cuts = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(words).to_numpy())].tolist()
        begin = 0
        for i, (end, other) in enumerate(zip(cuts, odd.to_pylist(), strict=True)):
            yield self.encode(texts[i].as_py()) if other else ids[begin:end]
            begin = end

    def _arrays(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self._make_room()
        given, every = compact(texts)
        texts = given
        rare = [a for a in (*self.added, *ODD_CONTROLS) if a.encode() in every]
        odd = reduce(pc.or_, [pc.match_substring(texts, a) for a in rare], pa.repeat(False, len(texts)))
        if any(lead in every for lead in (b"\xc2", b"\xe1", b"\xe2", b"\xe3")):
            odd = pc.or_(odd, pc.match_substring_regex(texts, ODD_SPACES))
        if pc.any(odd).as_py():
            texts, every = compact(pc.if_else(odd, "", texts))
        off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        begins = cut_words(np.frombuffer(every, np.uint8), off)
        coded = strings(begins, texts.buffers()[2]).dictionary_encode()
        flat, ends = self._word_ids(coded.dictionary)
        at, ends = spans(ends, coded.indices.to_numpy())
        ids = flat[at]
        cuts = np.concatenate([[0], ends])[np.searchsorted(begins, off[1:])].tolist()
        begin = 0
        for i, (end, other) in enumerate(zip(cuts, odd.to_pylist(), strict=True)):
            yield self.encode(given[i].as_py()) if other else ids[begin:end]
            begin = end

    def _word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that cut_words made, one after another, and where each word's begin and end."""
        words, raw = compact(words)
        off, data = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1), np.frombuffer(raw, np.uint8)
        begins, unsure = cut_pieces(data, off)
        pieces = strings(begins, words.buffers()[2]).dictionary_encode()
        flat, ends = self._piece_ids(pieces.dictionary)
        first = np.searchsorted(begins, off)  # of each word its first piece
        at, piece_ends = spans(ends, pieces.indices.to_numpy())
        flat, ends = flat[at], np.concatenate([[0], piece_ends])[first]
        if not len(unsure):
            return flat, ends
        others = [self._odd_word(words[i].as_py()) for i in unsure.tolist()]
        sizes = np.diff(ends)
        sizes[unsure] = [len(x) for x in others]
        new = np.concatenate([[0], np.cumsum(sizes)])
        sure = np.setdiff1d(np.arange(len(words)), unsure, assume_unique=True)
        out = np.empty(new[-1], np.uint32)
        out[spans(new, sure)[0]] = flat[spans(ends, sure)[0]]
        out[spans(new, unsure)[0]] = np.concatenate(others)
        return out, new

    def _odd_word(self, word: str) -> np.ndarray:
        """The ids of a word that the pattern may cut in ways cut_pieces doesn't know, remembered."""
        ids = self.others.get(word)
        if ids is None:
            if len(self.others) > self.max_words // 4:
                self.others = {}
            ids = self._all(word)
            if len(word) <= LONGEST:
                self.others[word] = ids
        return ids

    def _piece_ids(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after another, and where each piece's begin and end."""
        pieces, raw = compact(pieces)
        off, data = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1), np.frombuffer(raw, np.uint8)
        lengths = np.diff(off)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            these, n = order[a:b], int(lengths[order[a]])
            if n > LONGEST or len(these) < FEWEST:
                for i in these.tolist():
                    letters = raw[off[i] : off[i + 1]].decode("latin-1").translate(self.letters)
                    found.append((np.array([i]), np.array([[t.id] for t in self.bpe.tokenize(letters)], np.int64)))
            else:
                found += [(these[columns], ids) for columns, ids in self.merges.group(data[off[these] + np.arange(n)[:, None]])]
        sizes = np.zeros(len(pieces), np.int64)
        for columns, ids in found:
            sizes[columns] = len(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(ends[-1], np.uint32)
        for columns, ids in found:
            flat[ends[columns] + np.arange(len(ids))[:, None]] = ids
        return flat, ends

    def _all(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def word_ids(path: str, max_words: int = CACHE_WORDS, specials_as_text: bool = False) -> WordIds:
    """One per Python worker, so that its tasks share what words it knows."""
    return WordIds(path, max_words, specials_as_text)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
