"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Encoding reads a text once. A pretoken's byte symbols enter one by one; for each
prefix the transducer keeps the last token of the prefix's encoding. That token
is the only one that ends the prefix and whose pair with the encoding before it
encodes to itself, so each step looks at the tokens ending here and nothing
else. The encoding of a longer prefix leaves the chain of these tokens at one of
the last ``lookahead`` positions, ``lookahead`` being the longest token of the
merge list. Where the chains from all of them meet, everything before is stable:
it is emitted and forgotten. Memory is the open part and no more, whatever the
length of a pretoken. A text is read in blocks of words; tokens of words and
pretokens that come again are taken from tables that are bounded by bytes. Words
of a thousand characters and more are not kept and go through in blocks.

Decoding is the inverse and takes ids in any blocks. Byte-level vocabularies:
each token's bytes go through an incremental UTF-8 decoder that holds at most
three bytes back. A tokenizer file without a decoder joins token strings by one
space, and the state is whether one has been given.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import small_batches, text_of
from brindle.llm.token_cache import SPACE, Added, Generations, WordSplitter, byte_alphabet, kind_of, lowered, words_of

_END = 1 << 60
_COLUMNS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Merges:
    """A merge list: token strings, ranks of pairs, and the lookahead that makes a prefix's tokens final."""

    MOST = 200_000

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.lookahead = max((len(self.plain(t)) for t in self.vocab), default=1)
        #: Tokens inside a pretoken, and without their suffix those that end one.
        self.inner = {t for t in self.vocab if not self.suffix or not t.endswith(self.suffix)}
        self.ended = {self.plain(t) for t in self.vocab if t.endswith(self.suffix)} if self.suffix else self.inner
        #: Pairs of tokens that stand side by side in an encoding, and those that do not, as far as they were asked for.
        self.pairs: set[tuple[str, str]] = set()
        self.others: set[tuple[str, str]] = set()
        #: The length of the last token by the last symbols, as last seen.
        self.guesses: dict[str, int] = {}
        self.end_guesses: dict[str, int] = {}

    def plain(self, token: str) -> str:
        return token.removesuffix(self.suffix) if self.suffix else token

    def symbols(self, pretoken: str, last: bool = True) -> list[str]:
        out = list(pretoken)
        if out and last:
            out[-1] += self.suffix
        return out

    def merge(self, s: list[str]) -> list[str]:
        """Merge the leftmost pair of the lowest rank until none is left."""
        rank = self.rank.get
        held = [rank(p, _END) for p in zip(s, s[1:], strict=False)]
        while held and (least := min(held)) < _END:
            i = held.index(least)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del held[i]
            if i:
                held[i - 1] = rank((s[i - 1], s[i]), _END)
            if i < len(held):
                held[i] = rank((s[i], s[i + 1]), _END)
        return s

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens stand side by side in an encoding; with an empty ``a``, whether ``b`` is the encoding of itself. ``pairs`` has those that do."""
        pair = (a, b)
        if pair in self.pairs:
            return True
        if pair in self.others:
            return False
        for known in (self.pairs, self.others, self.guesses, self.end_guesses):
            if len(known) > self.MOST:
                known.clear()
        good = self.merge(self.symbols(a + self.plain(b), bool(self.suffix) and b.endswith(self.suffix))) == ([a, b] if a else [b])
        (self.pairs if good else self.others).add(pair)
        return good


class Transducer:
    """Tokens of one pretoken, fed in blocks: ``feed`` gives those that are final, ``finish`` the rest."""

    __slots__ = ("m", "text", "last", "start", "before")

    def __init__(self, merges: Merges):
        # last[i] is the last token of the encoding of the first i symbols held, and start[i] where it begins
        self.m, self.text, self.last, self.start, self.before = merges, "", [""], [0], ""

    def _take(self, block: str, ends: bool) -> None:
        """Append ``block``; for each new position find the last token of the encoding of what ends there."""
        m, last, start = self.m, self.last, self.start
        n = len(self.text)
        text = self.text = self.text + block
        pairs, known, guesses, suffix = m.pairs, m.inner, m.guesses, ""
        last[0], stop = self.before, n + len(block)
        for i in range(n + 1, stop + 1):
            if i == stop and ends:
                known, suffix, guesses = m.ended, m.suffix, m.end_guesses
            # exactly one place is right: first that the last token grows, then where such an end began before
            j = start[-1]
            if (piece := text[j:i]) in known and ((pair := (last[j], piece + suffix)) in pairs or m.fits(*pair)):
                last.append(pair[1])
                start.append(j)
                continue
            end = text[i - 3 if i > 3 else 0 : i]
            j = i - guesses.get(end, 1)
            if j < 0 or (piece := text[j:i]) not in known or (pair := (last[j], piece + suffix)) not in pairs and not m.fits(*pair):
                for j in range(i - 1, max(-1, i - 1 - m.lookahead), -1):
                    if (piece := text[j:i]) in known and ((pair := (last[j], piece + suffix)) in pairs or m.fits(*pair)):
                        break
                else:
                    raise ValueError("a symbol is not in the vocabulary")
                guesses[end] = i - j
            last.append(pair[1])
            start.append(j)

    def _final(self) -> int:
        """The last position that every later encoding passes."""
        live = set(range(max(0, len(self.text) - self.m.lookahead + 1), len(self.text) + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.start[top])
        return live.pop()

    def _tokens(self, until: int) -> list[str]:
        out = []
        while until:
            out.append(self.last[until])
            until = self.start[until]
        out.reverse()
        return out

    def feed(self, block: str) -> list[str]:
        """``block`` must not be the pretoken's last: its end is told by ``finish``."""
        self._take(block, False)
        at = self._final()
        out = self._tokens(at)
        if out:
            self.before, self.text, self.last, self.start = out[-1], self.text[at:], ["", *self.last[at + 1 :]], [0, *(max(0, x - at) for x in self.start[at + 1 :])]
        return out

    def finish(self, block: str) -> list[str]:
        """The tokens left, at the pretoken's end. What is shorter than the lookahead has none that is final before."""
        out, at = [], 0
        while len(block) - at > self.m.lookahead:
            out += self.feed(block[at : at + self.m.lookahead])
            at += self.m.lookahead
        self._take(block[at:], True)
        return out + self._tokens(len(self.text))


class BpeEncoder:
    """Ids of a ``words`` tokenizer file (see ``token_cache.kind_of``), as a stream.

    Every pretoken goes through the transducer. Tokens of words and of pretokens
    are kept in tables bounded by bytes, so that a word which comes again is not
    transduced again.
    """

    #: Characters of text that are cut into words at once, and those of a word from which on it is streamed and not kept.
    BLOCK, LONG = 1 << 15, 1 << 10

    def __init__(self, path: str, most_bytes: int = 288 << 20, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = Added(spec, specials)
        if kind_of(spec) != "words" or not self.added.plain:
            raise ValueError("the transducer takes tokenizer files whose words are separated by white space")
        self.merges, self.splitter, self.decoder = Merges(spec["model"]), WordSplitter(), decoder_of(spec)
        self.known, self.pretokens = Generations(most_bytes // 2), Generations(most_bytes // 2)

    def _pretokens(self, pretokens: list[str]) -> Iterator[tuple[int, ...]]:
        vocab = self.merges.vocab.__getitem__
        return (tuple(map(vocab, Transducer(self.merges).finish(p))) for p in pretokens)

    def _words(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        parts = list(map(self.splitter.pretokens, words))
        found = iter(self.pretokens.all(list(chain.from_iterable(parts)), self._pretokens, _size))
        return (next(found) if len(p) == 1 else tuple(chain.from_iterable(islice(found, len(p)))) for p in parts)

    def _long(self, word: str) -> Iterator[list[int]]:
        """A long word's tokens as they become final."""
        vocab = self.merges.vocab
        for piece in self.splitter.found(word):
            t, at = Transducer(self.merges), 0
            while len(piece) - at > self.LONG:
                yield [vocab[x] for x in t.feed(self.splitter.symbols(piece[at : at + self.LONG]))]
                at += self.LONG
            yield [vocab[x] for x in t.finish(self.splitter.symbols(piece[at:]))]

    def stream(self, text: str) -> Iterator[list[int]]:
        """The text's ids in blocks, in order."""
        for part, own in self.added.parts(text):
            if own is not None:
                yield [own]
                continue
            for block in blocks_of(part, self.BLOCK):
                words = words_of(lowered(block))
                if len(block) < self.LONG or max(map(len, words), default=0) < self.LONG:
                    yield list(chain.from_iterable(self.known.all(words, self._words, _size)))
                    continue
                for w in words:
                    if len(w) < self.LONG:
                        yield list(self.known.one(w, self._words, _size))
                    else:
                        yield from self._long(w)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]


def _size(ids: tuple[int, ...]) -> int:
    """Bytes of a tuple's places; the numbers themselves are the vocabulary's."""
    return 8 * len(ids)


_GAP = re.compile(SPACE)


def blocks_of(text: str, size: int) -> Iterator[str]:
    """The text in blocks of about ``size`` characters that end at white space; a longer run without any is one block."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


@lru_cache(2)
def encoder_for(path: str, specials: bool = True) -> BpeEncoder:
    """One encoder for each worker process, whose tasks share its tables."""
    return BpeEncoder(path, specials=specials)


class PieceDecoder:
    """Of a tokenizer file without a decoder: token strings joined by one space, in any blocks."""

    def __init__(self, pieces: dict[int, str]):
        self.pieces, self.begun = pieces, False

    def feed(self, ids: Iterable[int], end: bool = False) -> str:
        try:
            out = " ".join(map(self.pieces.__getitem__, ids))
        except KeyError:
            out = " ".join(self.pieces[i] for i in ids if i in self.pieces)
        out, self.begun = " " + out if self.begun and out else out, self.begun or bool(out)
        return out


class TextDecoder:
    """Of a byte-level vocabulary: bytes to text as they come; broken sequences become U+FFFD. Ends of words become one space."""

    def __init__(self, table: dict[int, bytes]):
        self.bytes, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def table(pieces: dict[int, str], suffix: str = "") -> dict[int, bytes]:
        back = {c: b for b, c in enumerate(byte_alphabet())}
        return {i: bytes(back[c] for c in t.removesuffix(suffix) if c in back) + (b" " if suffix and t.endswith(suffix) else b"") for i, t in pieces.items()}

    def feed(self, ids: Iterable[int], end: bool = False) -> str:
        return self.state.decode(b"".join(self.bytes[i] for i in ids if i in self.bytes), end)


def decoder_of(spec: dict) -> Callable[[], PieceDecoder | TextDecoder]:
    """What makes a fresh decoder, as the tokenizer file says."""
    pieces = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens") or []}
    kind = (spec.get("decoder") or {}).get("type")
    if kind is None:
        return lambda: PieceDecoder(pieces)
    if kind == "ByteLevel":
        table = TextDecoder.table(pieces)
        return lambda: TextDecoder(table)
    raise ValueError(f"no incremental decoder for {kind}")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, specials: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, asked for, ``ids, decoded``.

    Ids are those of the tokenizers library with ``add_special_tokens=False``;
    strings of special tokens in a text give their ids, the library's default,
    unless ``specials`` is False. The decoded text is that of its ``decode(ids,
    skip_special_tokens=False)``. Sums are carried on as tokens become final;
    nothing grows with a text but what is asked for by ``with_ids``. Null and
    empty texts have no ids and an empty decoded text. Null ids stay null,
    repeated rows give repeated rows, an empty table an empty result; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = _COLUMNS + ", ids array<bigint>, decoded string" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, specials)
        number = list(map(str, range(max(encoder.merges.vocab.values()) + 1))).__getitem__
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, listed, shown, decoder = 0, hashlib.sha256(), hashlib.sha256(), encoder.decoder()
                kept, said = [], []
                for ids in encoder.stream(text):
                    if ids:
                        try:
                            digits = " ".join(map(number, ids))
                        except IndexError:
                            digits = " ".join(map(str, ids))
                        listed.update((" " + digits if n else digits).encode())
                        out = decoder.feed(ids)
                        shown.update(out.encode())
                        n += len(ids)
                        if with_ids:
                            kept += ids
                            said.append(out)
                out = decoder.feed((), True)
                shown.update(out.encode())
                row = [doc, n, listed.hexdigest(), shown.hexdigest()]
                rows.append([*row, kept, "".join(said) + out] if with_ids else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()][: 6 if with_ids else 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(work, schema)
