"""Tokenization of whole texts by the tokenizers library, shared by the token store and packing.

Byte-level BPE never merges across a space that starts a word, so a text can be cut there, and a piece that was seen
before need not be encoded again: a worker keeps a bounded memory of pieces. The ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Pieces a worker remembers before it starts a new generation, for which it keeps what still occurs.
MEMORY = 600_000

_LINE = re.compile(r"(?<=\S)(\n)(?=\S)")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Cut ``text`` where the pre-tokenization pattern of byte-level BPE always cuts.

    That is before a space followed by a character that isn't white space, and around a line feed that stands
    between two such characters. The pieces joined give the text.
    """
    out: list[str] = []
    for line in _LINE.split(text) if "\n" in text else (text,):
        words = line.split(" ")
        if "" not in words and not any(map(str.isspace, [w[0] for w in words])):
            out.append(words[0])
            out.extend([" " + w for w in words[1:]])
            continue
        start = True
        for w in words:
            if start:
                if w:
                    out.append(w)
                else:
                    out.append("")
                start = False
            elif not w or w[0].isspace():
                out[-1] += " " + w
            else:
                out.append(" " + w)
    return [p for p in out if p] if "" in out else out


#: Stands in a list of words where a text or line starts; no text holds it, as it has white space inside.
_START = " \n "


class Remembered:
    """Maps texts to ids by a memory of pieces; ``encode`` gives the ids of pieces it hasn't seen.

    ``spaced`` holds pieces that start with a blank, without it, so that the words of an ordinary text need no joining.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], dtype: str, limit: int = MEMORY):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.seen: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {_START: b""}
        self.before: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            words = text.split()
            gaps = len(words) - 1
            feeds = text.count("\n")
            # all white space is single blanks and line feeds between other characters
            plain = len("".join(words)) + gaps == len(text) and text.count(" ") + feeds == gaps
            found = self._plain(words, text if feeds else None) if plain else self._odd(text)
            out.append(np.frombuffer(b"".join(found), self.dtype))
            if len(self.seen) + len(self.spaced) > self.limit:
                self.before = {"": self.seen, " ": self.spaced}
                self.seen, self.spaced = {}, {_START: b""}
        return out

    def _odd(self, text: str) -> list[bytes]:
        return self._find(self.seen, pieces(text), "")

    def _plain(self, words: list[str], lines: str | None) -> list[bytes]:
        """Every word is a piece with the blank before it, unless it starts the text or a line of ``lines``."""
        starts = [0]
        for line in lines.split("\n")[:-1] if lines else ():
            starts.append(starts[-1] + line.count(" ") + 1)
        first = self._find(self.seen, [words[k] for k in starts] + ["\n"] * bool(lines), "")
        for k in starts:
            words[k] = _START
        found = self._find(self.spaced, words, " ")
        feed = first[-1] if lines else b""
        for k, ids in zip(starts, first, strict=False):
            found[k] = feed + ids if k else ids
        return found

    def _find(self, known: dict[str, bytes], words: list[str], prefix: str) -> list[bytes]:
        found = list(map(known.get, words))
        if None in found:
            self._learn(known, {w for w, ids in zip(words, found, strict=True) if ids is None}, prefix)
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _learn(self, into: dict[str, bytes], new: set[str], prefix: str) -> None:
        """A word with one mark after it is the word's ids and the mark's: the pattern cuts between them."""
        marked, need, before = [], [], self.before[prefix]
        for p in new:
            if p in before:
                into[p] = before[p]
            elif len(p) > 1 and p[-1] in ".,;:!?" and p[-2].isalpha():
                marked.append(p)
                if p[:-1] not in into and p[:-1] not in new:
                    need.append(p[:-1])
            else:
                need.append(p)
        marks = sorted({p[-1] for p in marked}.difference(self.seen))
        need = list(dict.fromkeys(need))
        for found, names, lead in ((self.seen, marks, ""), (into, need, prefix)):
            for at in range(0, len(names), 1024):
                part = names[at : at + 1024]
                for p, ids in zip(part, self.encode([lead + p for p in part]), strict=True):
                    found[p] = array(self.code, ids).tobytes()
        for p in marked:
            into[p] = into[p[:-1]] + self.seen[p[-1]]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WholeTexts:
    """Encodes every text at once, for tokenizers of another kind than byte-level BPE."""

    def __init__(self, tokenizer, dtype: str):  # noqa: ANN001
        self.tokenizer, self.dtype = tokenizer, dtype

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class AddedTokens:
    """Cuts texts at the strings of added tokens, which are ids of their own, and encodes what stands between them."""

    def __init__(self, between: Remembered, added: dict[str, int]):
        self.between, self.dtype, self.added = between, between.dtype, added
        # as the library reads a text: from the left, the longest where several start
        self.strings = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = self.between([t if self.strings.search(t) is None else "" for t in texts])
        for k, text in enumerate(texts):
            if not len(out[k]) and self.strings.search(text):
                found, at = [], 0
                for m in self.strings.finditer(text):
                    found += [*self.between([text[at : m.start()]]), np.array([self.added[m[0]]], self.dtype)]
                    at = m.end()
                out[k] = np.concatenate([*found, *self.between([text[at:]])])
        return out


_READY: dict[tuple[str, bool], Remembered | AddedTokens | WholeTexts] = {}


def text_encoder(file: str | None = None, special: bool = True) -> Remembered | AddedTokens | WholeTexts:
    """The encoder of a worker process for a tokenizers file; kept between tasks.

    As in the library's own default, the string of an added token inside a text becomes that token; with ``special`` false
    it is ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = file or vocabulary_file()
    if (path, special) not in _READY:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        dtype = "<u2" if tokenizer.get_vocab_size() < 65536 else "<u4"
        added = list(tokenizer.get_added_tokens_decoder().items())
        kinds = [type(x).__name__ for x in (tokenizer.pre_tokenizer, tokenizer.model, tokenizer.normalizer)]
        # tokens that take white space with them or stand at words only are left to the library, as is another kind
        bound = any(t.lstrip or t.rstrip or t.single_word or (not special and not t.special) for _, t in added)
        if kinds != ["ByteLevel", "BPE", "NoneType"] or bound:
            _READY[path, special] = WholeTexts(tokenizer, dtype)
            return _READY[path, special]
        model, letters = tokenizer.model, _byte_letters()
        blank = letters[32]
        model._resize_cache(0)  # every piece comes once

        def encode(new: list[str]) -> list[list[int]]:
            """A Latin word is one pre-token, so the library's model takes it as it is; the rest goes through all steps."""
            out = []
            for p in new:
                word = p[1:] if p[0] == " " else p
                if not word.isalpha():
                    out.append(tokenizer.encode(p, add_special_tokens=False).ids)
                elif word.isascii():
                    out.append([t.id for t in model.tokenize(blank + word if p[0] == " " else word)])
                elif max(word) < "\u0250":
                    out.append([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))])
                else:
                    out.append(tokenizer.encode(p, add_special_tokens=False).ids)
            return out

        plain = Remembered(encode, dtype)
        _READY[path, special] = AddedTokens(plain, {t.content: i for i, t in added}) if special and added else plain
    return _READY[path, special]
