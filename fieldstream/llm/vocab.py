"""Public vocabularies inside tasks, with a bounded memo of words.

A text is cut where no token can span the cut, and each part's ids are kept in
a memo, so a frequent word is tokenised once for each worker.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

#: Words of one generation of a memo.
MEMO = 200_000
#: The longest part that is kept.
LONGEST = 40
#: White space that isn't alone, beside a space or line feed, or at either end.
UNEVEN = re.compile(r"\s[ \n]|[ \n]\s|\A\s|\s\Z")
OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of white space from this length on are taken out before the pre-token pattern sees them: its look-ahead backtracks over a run and gives up on very long ones.
LONG_BLANKS = 4096
BLANK_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANKS)
END = "<|endoftext|>"
#: The sign that sentencepiece writes for a space.
SPACE = "▁"


def uneven(text: str) -> bool:
    """Whether ``UNEVEN`` matches; without other white space than spaces and line feeds, plain searches tell."""
    if OTHER_SPACE.search(text):
        return UNEVEN.search(text) is not None
    return text[:1] in " \n" or text[-1:] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text


class Memo:
    """word -> what ``encode_many`` makes of it, in two generations.

    When the young one is full it becomes the old one, and a word of the old one
    that is met again moves over, so frequent words stay.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable]):
        self.encode_many, self.now, self.old = encode_many, {}, {}

    def get(self, words: list[str]) -> list:
        now = self.now
        out = list(map(now.get, words))
        if None not in out:
            return out
        fresh = []
        for w in {w for w, known in zip(words, out, strict=True) if known is None}:
            known = self.old.get(w)
            if known is None:
                fresh.append(w)
            else:
                now[w] = known
        if fresh:
            now.update(zip(fresh, self.encode_many(fresh), strict=True))
        out = list(map(now.__getitem__, words))
        for w in fresh:
            if len(w) > LONGEST:
                del now[w]
        if len(now) > MEMO:
            self.old, self.now = now, {}
        return out


def _cut(ids: np.ndarray, opens: np.ndarray) -> list[bytes]:
    """The bytes of ids, cut before each id that ``opens`` marks."""
    at = np.append(np.flatnonzero(opens[ids]) * 4, 4 * len(ids)).tolist()
    data = ids.tobytes()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class ByteBpe:
    """Byte-level BPE from a ``.tiktoken`` file; ``ids`` equals ``tokenizers`` with the twin ``.json`` file and add_special_tokens=False.

    The library is faster on whole texts than a memo of words is.  In ``encode_many``, a lone space between
    two other characters starts a new pre-token of the vocabulary's pattern, and of the tokens of a word
    with its space only the first can start with one.
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end_id = len(ranks)
        self.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.one_piece = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(len(ranks) + 1, bool)
        self.opens[[k for token, k in ranks.items() if token[:1] == b" "]] = True
        #: Tokens after which a sentence ends: closing punctuation, or a line feed.
        self.closes = np.zeros(len(ranks) + 1, bool)
        for token, k in ranks.items():
            self.closes[k] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?", "…".encode(), "。".encode())) or b"\n" in token

    def encode_many(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        return _cut(np.frombuffer(self.plain(" " + " ".join(words)), "<u4"), self.opens)

    def plain(self, text: str) -> bytes:
        """The ids of a text without the special string.

        Of a run of white space, all but the last character is one pre-token, or the whole run where it ends the
        text; so the text may be cut there.
        """
        if len(text) < LONG_BLANKS:
            return np.array(self.enc.encode_ordinary(text), "<u4").tobytes()
        out, at = [], 0
        for m in BLANK_RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self.enc.encode_ordinary(text[at : m.start()]), self.one_piece.encode_ordinary(text[m.start() : end])]
            at = end
        out.append(self.enc.encode_ordinary(text[at:]))
        return b"".join(np.array(ids, "<u4").tobytes() for ids in out)

    def ids(self, text: str) -> np.ndarray:
        if END not in text:
            return np.frombuffer(self.plain(text), "<u4")
        end = np.array([self.end_id], "<u4").tobytes()
        return np.frombuffer(end.join(map(self.plain, text.split(END))), "<u4")


class Pieces:
    """A sentencepiece BPE model; ``ids`` equals the library's encode.

    No piece of the vocabulary holds the space sign after another character
    (checked on loading), so no merge crosses the start of a run of spaces.
    """

    def __init__(self, name: str = "piece_bpe_32k.model"):
        self.path = public_tokenizers.path(name)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.byte = np.array([self.sp.is_byte(i) for i in range(len(names))])
        self.names = names
        self.apart = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.opens = np.array([n.startswith(SPACE) for n in names])
        self.memo = Memo(self.encode_many)

    def encode_many(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        return _cut(np.array(self.sp.encode(" ".join(words)), "<u4"), self.opens)

    def ids(self, text: str) -> np.ndarray:
        # at the start the library adds a space; one that ends the text would be a word of its own
        if not self.apart or "  " in text or text[:1] == " " or text[-1:] == " " or SPACE in text or not text:
            return np.array(self.sp.encode(text), "<u4")
        return np.frombuffer(b"".join(self.memo.get(text.split(" "))), "<u4")


@lru_cache(maxsize=2)
def byte_bpe(name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(name)


@lru_cache(maxsize=2)
def pieces(name: str = "piece_bpe_32k.model") -> Pieces:
    """One for each worker process."""
    return Pieces(name)
