"""Byte-pair encoding as a streaming transducer over a public merge list.

The tokens of every prefix of a word end in exactly one token, and which one it is follows from the prefixes before it: it is the
token t that ends here, whose left neighbour (the last token of the prefix without t) is compatible with it, that is, encoding
the two together gives the two again. So one pass from left to right, which keeps one last token a position, encodes all
prefixes at once. A token is stable, and is emitted, once the last tokens of the final ``lookahead`` positions all descend from it: a
token that is still to come begins within the length of the longest token, which is the lookahead that suffices for the merge
list. Older positions are dropped, so memory is constant however long a word is.

Files and libraries of tokenizers are found by name, see ``load``.
"""

from __future__ import annotations

import base64
import codecs
import itertools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: Pre-split of the byte-level vocabularies (fixed, from the vocabulary's own description).
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their tokens by one worker; beyond that the memory is emptied and filled anew.
MEMORY = 400_000
#: Characters of a text whose words are listed at once.
LONG = 1 << 18
#: Longer words are streamed and not kept.
KEPT_BYTES = 256


def folder() -> str:
    """Folder of the public tokenizers: GRISTMILL_TOKENIZERS, else /opt/tokenizers."""
    return os.environ.get("GRISTMILL_TOKENIZERS", "/opt/tokenizers")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow on 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + n)] = b
    return letters


class Merges:
    """Tokens of a byte-level BPE: bytes to id, bytes of each id, and the rank at which a pair of tokens merges."""

    def __init__(self, ids: dict[bytes, int], ranks: dict[tuple[int, int], int], made: dict[tuple[int, int], int]):
        self.ids, self.ranks, self.made = ids, ranks, made
        self.bytes = {i: b for b, i in ids.items()}
        #: Pair that a token is made of, with the rank of that merge; single bytes have none.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for pair, token in made.items():
            rank = ranks[pair]
            if token not in self.parts or rank < self.parts[token][2]:
                self.parts[token] = (*pair, rank)
        #: The lookahead that suffices for the merge list: a token that is still to come begins within the length of the longest one.
        self.lookahead = max(map(len, ids), default=1)
        lengths: dict[int, set[int]] = {}
        for b in ids:
            lengths.setdefault(b[-1], set()).add(len(b))
        self.by_last = {k: sorted(v) for k, v in lengths.items()}
        self._built: dict[bytes, int] = {}
        self._compatible: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_json(cls, path: str) -> Merges:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        vocabulary = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        ids = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        ranks, made = {}, {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = (vocabulary[a], vocabulary[b])
            ranks[pair], made[pair] = rank, vocabulary[a + b]
        # A special token is no product of merges and never comes from text.
        products = set(made.values())
        return cls({b: i for b, i in ids.items() if len(b) == 1 or i in products}, ranks, made)

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        ids = {}
        for line in open(path, "rb"):
            token, rank = line.split()
            ids[base64.b64decode(token)] = int(rank)
        ranks, made = {}, {}
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    ranks[a, b], made[a, b] = rank, rank
        return cls(ids, ranks, made)

    def _merge(self, word: bytes) -> list[int]:
        """The definition itself: merge the leftmost pair of lowest rank until there is none."""
        tokens = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(tokens) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(tokens, tokens[1:])))
            if rank == 1 << 60:
                break
            pair = (tokens[at], tokens[at + 1])
            out, i = [], 0
            while i < len(tokens):
                if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) == pair:
                    out.append(self.made[pair])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def token(self, word: bytes) -> int:
        """The token that is these bytes, or -1: there is none, or the merges never build it from its own bytes, so that it cannot occur. Decided
        when it is first asked for, so that a worker starts at once."""
        known = self._built.get(word)
        if known is None:
            number = self.ids.get(word, -1)
            known = self._built[word] = number if number < 0 or len(word) == 1 or self._merge(word) == [number] else -1
            if number < 0 and len(self._built) > MEMORY:
                self._built.clear()
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side: their bytes together encode to just these two."""
        known = self._compatible.get((left, right))
        if known is None:
            known = self._merge(self.bytes[left] + self.bytes[right]) == [left, right]
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            self._compatible[left, right] = known
        return known

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word given in pieces, each emitted as soon as no continuation can change it."""
        tail = b""  # bytes of the window, from position `base` on
        base = 0
        last: list[int] = [-1]  # last[k]: last token of the prefix that ends at base + k
        start: list[int] = [0]  # where that token begins
        emitted = 0  # all before this position is out
        usable, by_last, longest = self.token, self.by_last, self.lookahead
        for piece in pieces:
            for value in piece:
                tail += bytes((value,))
                end = base + len(tail)
                for length in by_last.get(value, ()):
                    begin = end - length
                    if begin < emitted or begin < base:
                        break
                    token = usable(tail[begin - base :])
                    if token < 0:
                        continue
                    left = last[begin - base]
                    if left == -2:
                        continue
                    if left == -1 or self.compatible(left, token):
                        last.append(token)
                        start.append(begin)
                        break
                else:
                    last.append(-2)
                    start.append(-1)
                if len(last) == len(tail):  # the loop broke off without a token
                    last.append(-2)
                    start.append(-1)
                if len(tail) >= 4 * longest:
                    yield from (out := self._stable(base, last, start, emitted, longest))
                    if out:
                        emitted += sum(len(self.bytes[t]) for t in out)
                        keep = emitted - base
                        tail, last, start, base = tail[keep:], last[keep:], start[keep:], emitted
        path, at = [], base + len(tail)
        while at > emitted:
            path.append(last[at - base])
            at = start[at - base]
        yield from reversed(path)

    def _stable(self, base: int, last: list[int], start: list[int], emitted: int, longest: int) -> list[int]:
        """Tokens from ``emitted`` on that all of the final positions descend from."""
        end = base + len(last) - 1
        common: list[int] | None = None
        for position in range(end, max(emitted, end - longest), -1):
            if last[position - base] == -2:
                continue
            path, at = [], position
            while at > emitted:
                path.append(at)
                at = start[at - base]
            path.reverse()
            if common is None:
                common = path
            else:
                n = 0
                while n < min(len(common), len(path)) and common[n] == path[n]:
                    n += 1
                common = common[:n]
            if not common:
                return []
        return [last[p - base] for p in common or []]

    def word(self, word: bytes) -> list[int]:
        return list(self.stream((word,)))


class ByteEncoder:
    """Texts to ids by a byte-level BPE. Strings of special tokens are ordinary text."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.split = regex.compile(PRESPLIT)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """int32 ids of a text of any length; empty for the empty text."""
        known, lots = self.known, []
        for words in self._lots(text):
            try:
                lots.append(b"".join([known[w] for w in words]))
            except KeyError:
                lots.append(b"".join([known[w] if w in known else self._new(w) for w in words]))
        return np.frombuffer(b"".join(lots), dtype=np.int32)

    def _lots(self, text: str) -> Iterator[list[str]]:
        """The words of a text, of a long one in lots, so that its words are never all held at once."""
        if len(text) <= LONG:
            yield self.split.findall(text)
            return
        found = self.split.finditer(text)
        while words := [m.group() for m in itertools.islice(found, LONG // 8)]:
            yield words

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def _new(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        pieces = (raw[i : i + 4096] for i in range(0, len(raw), 4096))
        out = np.fromiter(self.merges.stream(pieces), dtype=np.int32).tobytes()
        if len(raw) <= KEPT_BYTES:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = out
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece: bytes that do not yet make a character wait for the next token."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = machine.decode(self.merges.bytes.get(int(i), b""))
            if piece:
                yield piece
        piece = machine.decode(b"", True)
        if piece:
            yield piece


class LibraryEncoder:
    """The public tokenizers that are no byte-level BPE, by the libraries their files are made for."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self._encode = lambda text: model.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), dtype=np.int32)

    def count(self, text: str) -> int:
        return len(self._encode(text)) if text else 0


_loaded: dict[tuple[str, str], ByteEncoder | LibraryEncoder] = {}


def load(name: str, at: str | None = None):
    """The encoder of a public tokenizer, loaded once a worker. ``at`` is the folder of the files."""
    at = at or folder()
    if (at, name) not in _loaded:
        files = [f for f in (f"{at}/{name}{x}" for x in (".json", ".tiktoken", ".model")) if os.path.exists(f)]
        if not files:
            raise FileNotFoundError(f"no tokenizer {name} in {at}")
        if files[0].endswith(".tiktoken"):
            _loaded[at, name] = ByteEncoder(Merges.from_ranks(files[0]))
        elif files[0].endswith(".json") and _is_byte_level(files[0]):
            _loaded[at, name] = ByteEncoder(Merges.from_json(files[0]))
        else:
            _loaded[at, name] = LibraryEncoder(files[0])
    return _loaded[at, name]


def _is_byte_level(path: str) -> bool:
    described = json.load(open(path, encoding="utf-8"))
    return not described["normalizer"] and described["pre_tokenizer"].get("type") == "ByteLevel" and not described["model"].get("end_of_word_suffix")
