"""Encoding whole texts with a public tokenizer, fast on text that repeats its words.

The tokenizer's own steps are kept: its normaliser, its pattern, its merge model. What is added is memory: a text is cut at
single spaces, where these tokenizers never join characters, and pieces and pattern matches that were met before are looked up.
A text with characters or runs of white space for which that rule isn't proven goes through the tokenizer as a whole, and so does one
that holds an added token such as ``<|endoftext|>``, unless special tokens are to be read as text (``plain``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: anything but Latin, Greek, Cyrillic and Armenian text with usual punctuation; also separators on which pattern engines differ
UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-֏‐-‧‰-⁞₠-₿]")
#: white space where a cut at one space could change the matches of the pattern
RUNS = re.compile(r"[ \t\n\r\x0b\x0c]{3}|[ \t\n\r\x0b\x0c]{2}\Z")
#: a text without any of these has no such run
RUN_STARTS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
PUNCTUATION = ".,;:!?()[]{}*#$%&|/+-=_<>@^~\"`"
#: pieces that a worker keeps, their most bytes, and matches in other pieces in each of two generations
KEPT, LONGEST, KEPT_MATCHES = 600_000, 64, 30_000
#: longest text that is cut into pieces at once, in characters, and about so many characters of texts are encoded together
STEP, TOGETHER = 1 << 20, 1 << 22

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

# fixed values: the patterns by which the two vocabularies cut text before merging
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def public_path(name: str) -> str:
    """Place of a vocabulary file on this machine (the package is installed on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Memory(dict):
    """Bytes by text in two generations: a full one becomes the old one, from which what is met again comes back."""

    def __init__(self, make: Callable[[str], bytes], kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def strings(values: pa.Array, places: np.ndarray) -> list:
    return values.take(pa.array(places)).to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer on each whole text.

    With ``plain`` the strings of added special tokens are text like any other (the tokenizer's ``encode_special_tokens``).
    """

    def __init__(self, name: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_path(name))
        self.tokenizer.encode_special_tokens = plain
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special))
        self.merge = self.tokenizer.model.tokenize
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        self.find = regex.compile(WORD_PATTERN if self.normal else BYTE_PATTERN).findall
        self.space = "" if self.normal else " "
        self.letters = byte_letters()
        self.lead = self.space.translate(self.letters)
        self.coded = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.matches = Memory(self.matched, KEPT_MATCHES)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def matched(self, match: str) -> bytes:
        found = self.merge(match.encode().decode("latin-1").translate(self.letters))
        return b"".join([self.coded[t.id] for t in found])

    def piece(self, text: str) -> bytes:
        """Ids of a short stretch by the tokenizer's steps."""
        if self.normal:
            text = text.lower() if text.isascii() else self.normal(text)
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def word(self, core: str) -> str | None:
        """Letters as the tokenizer merges them, or None if there is anything else."""
        if not core.isalpha():
            return None
        if not self.normal:
            return core
        word = core.lower() if core.isascii() else self.normal(core)
        return word if word.isalpha() else None

    def after_space(self, piece: str) -> bytes:
        """Ids of a piece that follows a space; letters alone are one match."""
        word = self.word(piece)
        if word is None:
            return self.piece(" " + piece)
        if word.isascii():  # letters that stand for themselves
            return b"".join([self.coded[t.id] for t in self.merge(self.lead + word)])
        return self.matched(self.space + word)

    def look_up(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids, and for each of the distinct pieces, all of which follow a space, the place of its own among them.

        Letters with punctuation behind them are the word's ids and the punctuation's. Pieces and their words are remembered; a full
        memory goes on with those of this call. Very long ones are not kept.
        """
        n = len(pieces)
        both = pa.concat_arrays([pieces, pc.utf8_rtrim(pieces, characters=PUNCTUATION)]).dictionary_encode()
        asked, core = both.dictionary, np.asarray(both.indices)[n:]
        at = np.array(pc.index_in(asked, value_set=self.words).fill_null(-1), np.int64)
        new = np.flatnonzero(at < 0)
        ends_so = np.zeros(len(asked), bool)
        ends_so[:n] = core != np.arange(n)
        bare, tailed = new[~ends_so[new]], new[ends_so[new]]
        ids = pa.concat_arrays([self.ids, pa.array(map(self.after_space, strings(asked, bare)), pa.large_binary())])
        at[bare] = np.arange(len(self.ids), len(ids))
        known = strings(ids, at[core[tailed]])
        made = [
            self.piece(" " + piece) if self.word(word) is None else begin + self.matches[piece[len(word) :]]
            for piece, word, begin in zip(strings(asked, tailed), strings(asked, core[tailed]), known)
        ]
        at[tailed] = np.arange(len(ids), len(ids) + len(made))
        ids = pa.concat_arrays([ids, pa.array(made, pa.large_binary())])
        short = np.asarray(pc.binary_length(asked)) <= LONGEST
        new = new[short[new]]
        if len(self.words) + len(new) > KEPT:
            new = np.flatnonzero(short)[:KEPT]
            self.words, self.ids = self.words.slice(0, 0), self.ids.slice(0, 0)
        self.words = pa.concat_arrays([self.words, asked.take(pa.array(new))])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(at[new]))])
        return ids, at[:n]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """One bytes object for each text; null counts as empty. Texts of about ``TOGETHER`` characters are encoded at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self.together(held)
                held, size = [], 0
        yield from self.together(held)

    def together(self, texts: list[str]) -> list[bytes]:
        found, rest = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if UNSURE.search(text) or any(x in text for x in self.added) or (any(x in text for x in RUN_STARTS) and RUNS.search(text)):
                found[k] = self.whole(text)
            elif len(text) > STEP:
                found[k] = b"".join(self.steps(text))
            elif text:
                rest.append(k)
        for k, ids in zip(rest, self.pieces([texts[k] for k in rest], True)):
            found[k] = ids
        pa.default_memory_pool().release_unused()
        return found

    def steps(self, text: str) -> Iterator[bytes]:
        """A very long text, a stretch at a time; each ends before a space."""
        start = 0
        while start < len(text):
            end = text.find(" ", start + STEP)
            end = len(text) if end < 0 else end
            yield from self.pieces([text[start + (start > 0) : end]], start == 0)
            start = end

    def pieces(self, texts: list[str], first: bool) -> list[bytes]:
        """Ids of each text, which begins a document (``first``) or follows a space. Each distinct piece is looked up once."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        places = np.asarray(split.offsets)
        listed = split.values.dictionary_encode()
        ids, at = self.look_up(listed.dictionary)
        which = at[np.asarray(listed.indices)]
        if first:
            which[places[:-1]] = np.arange(len(ids), len(ids) + len(texts))
            ids = pa.concat_arrays([ids, pa.array([self.piece(text.split(" ", 1)[0]) for text in texts], pa.large_binary())])
        joined = ids.take(pa.array(which))
        _, offsets, data = joined.buffers()
        ends, data = np.frombuffer(offsets, np.int64)[places].tolist(), memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, plain: bool = True) -> Encoder:
    """The worker's encoder of this vocabulary."""
    if (name, plain) not in _ENCODERS:
        _ENCODERS[name, plain] = Encoder(name, plain)
    return _ENCODERS[name, plain]
