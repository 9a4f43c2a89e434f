"""Token ids of whole texts, exactly as the tokenizers library gives them, at a speed that suits a corpus.

The tokenizer's file decides how:

- ``words``: white space is dropped and separates words. A text is cut there
  and each new word is encoded by the library; words of Latin letters go straight
  to the library's model, all others through its whole chain. Words are kept in a
  table that is bounded by bytes.
- ``bytes``: the byte-level pattern and merges with nothing else. The same
  vocabulary and merge order are given to tiktoken, which is faster.
- ``whole``: anything else goes to the library, text by text.

Strings of added tokens are cut out first and give their own ids, as the library does
by default. With ``specials`` False those that the file calls special are ordinary
text, as with the library's ``encode_special_tokens``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Python's str.split() also splits at these four, which are no white space in Unicode.
_ODD = re.compile("[\x1c-\x1f]")
SPACE = "[\t-\r \x85\xa0  -     　]+"
#: A pattern whose matches never contain white space, kept and encoded by themselves.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Text in which lower case is a matter of single characters and every sequence is composed.
_LATIN = re.compile("[\t-\r -~\x85\xa0-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]*")


def lowered(text: str) -> str:
    """The text in lower case, where that is the same for the whole text and for each of its words; else the text itself."""
    return text.lower() if text.isascii() or _LATIN.fullmatch(text) else text


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SPACE, text) if w] if _ODD.search(text) else text.split()


def kind_of(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    steps = pre.get("pretokenizers") or [{}]
    if pre.get("type") == "Sequence" and steps[0].get("type") == "Split" and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True):
        if [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}:
            return "words"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["model"].get("end_of_word_suffix") is None and not spec["model"].get("ignore_merges"):
        return "bytes"
    return "whole"


class Added:
    """The added tokens of a tokenizer file that are looked for in texts, at their leftmost longest match."""

    def __init__(self, spec: dict, specials: bool):
        found = [x for x in spec.get("added_tokens") or [] if specials or not x["special"]]
        #: Whether a match depends on the string alone; the library has to look for all others.
        self.plain = not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in found)
        self.ids = {x["content"]: x["id"] for x in found}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")")

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at added tokens, which are parts of their own and come with their id."""
        at = 0
        if any(t in text for t in self.ids):
            for m in self.pattern.finditer(text):
                if at < m.start():
                    yield text[at : m.start()], None
                yield m[0], self.ids[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:] if at else text, None


class Generations:
    """A table bounded by bytes. A full young table becomes the old one, and old entries come back as they are used; so what is frequent stays."""

    #: Bytes of an entry besides its key and value.
    OVERHEAD = 200

    def __init__(self, most_bytes: int):
        self.young, self.old, self.most, self.held = {}, {}, most_bytes // 2, 0

    def put(self, key: str, value, size: int):
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += size + len(key) + self.OVERHEAD
        return value

    def all(self, keys: list[str], made: Callable[[list[str]], Iterable], size: Callable[[object], int]) -> list:
        """The values of ``keys``; ``made`` makes those of keys that neither table has, and ``size`` tells a value's bytes."""
        missing = dict.fromkeys(set(keys).difference(self.young))
        if not missing:
            return list(map(self.young.__getitem__, keys))
        for k in missing:
            missing[k] = self.old.get(k)
        new = [k for k, x in missing.items() if x is None]
        missing.update(zip(new, made(new), strict=True))
        young = self.young
        for k, x in missing.items():
            self.put(k, x, size(x))
        return list(map(self.young.__getitem__, keys)) if self.young is young else [missing[k] if k in missing else young[k] for k in keys]

    def one(self, key: str, made: Callable[[list[str]], Iterable], size: Callable[[object], int]):
        x = self.young.get(key)
        return self.all([key], made, size)[0] if x is None else x


class WordSplitter:
    """The pretokens of one word of a ``words`` tokenizer, in the byte alphabet."""

    #: Characters of these ranges have one reading in every Unicode version.
    PLAIN = re.compile("[!-~\xa1-ɏ]+")

    def __init__(self):
        import regex

        self.pattern = regex.compile(WORD_PATTERN)
        self.table = dict(enumerate(byte_alphabet()))

    def found(self, word: str) -> Iterator[str]:
        """The pretokens as they are written, in lower case."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        low = word.lower() if word.isascii() else "".join(c.lower() for c in word)
        return (m[0] for m in self.pattern.finditer(low))

    def symbols(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.table)

    def pretokens(self, word: str) -> list[str]:
        if word.isascii() and word.isalpha():
            return [word.lower()]
        return list(map(self.symbols, self.found(word)))


class CachedEncoder:
    """``ids(text)``: the text's token ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, most_bytes: int = 256 << 20, specials: bool = True, width: int = 4):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added, self.width, self.kind_of_array = Added(spec, specials), width, {2: "H", 4: "I"}[width]
        self.kind = kind_of(spec) if self.added.plain else "whole"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # between added tokens there is none left to find
        self.tokenizer.encode_special_tokens = self.kind != "whole" or not specials
        if self.kind == "words":
            self.splitter, self.known, self.model = WordSplitter(), Generations(most_bytes), self.tokenizer.model
        if self.kind == "bytes":
            import tiktoken

            back = {c: b for b, c in enumerate(byte_alphabet())}
            special = {x["content"] for x in spec["added_tokens"]}
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def narrow(path: str, *others: int) -> int:
        """The bytes of an id in which the file's ids and ``others`` fit: 2 or 4."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens") or []), *others])
        return 2 if most < 1 << 16 else 4

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind_of_array, ids).tobytes()

    def whole(self, text: str) -> bytes:
        """By the library's whole chain."""
        return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        tokens, packed, plain = self.model.tokenize, self.packed, self.splitter.PLAIN.fullmatch
        for w in words:
            if w.isascii() and w.isalpha():
                yield packed([t.id for t in tokens(w.lower())])
            elif plain(w):
                yield packed([t.id for p in self.splitter.pretokens(w) for t in tokens(p)])
            else:
                yield self.whole(w)

    def _part(self, text: str) -> bytes:
        if self.kind == "bytes":
            return self.packed(self.fast.encode_ordinary(text))
        if self.kind == "whole":
            return self.whole(text)
        return b"".join(self.known.all(words_of(lowered(text)), self._words, len))

    def ids(self, text: str) -> bytes:
        if self.kind == "whole":
            return self.whole(text)
        return b"".join([self._part(p) if own is None else self.packed([own]) for p, own in self.added.parts(text)])


@lru_cache(2)
def encoder_for(path: str, specials: bool = True, width: int = 4) -> CachedEncoder:
    """One encoder for each worker process, whose tasks share its tables."""
    return CachedEncoder(path, specials=specials, width=width)
