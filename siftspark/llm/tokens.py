"""Token ids of a public BPE vocabulary: a buffer of texts is cut by array operations and merged by a fast library."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Characters encoded at once; a longer text is taken in stretches that end at white space.
CHARS_AT_ONCE = 1 << 19
_encoders: dict[str, WordEncoder] = {}
#: The marks' bytes, and white space (in Python or in the vocabulary's library) besides ASCII's.
_ODD = re.compile("[\x01-\x03\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Texts of these characters need no normalizer but lower case.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_NEVER = re.compile(r"(?!)")
_SPACE = re.compile(r"[\t-\r ]")
#: Marks: end of a part, of a text, and the place of a word that the vocabulary's own library encodes.
_END, _MARK, _BETWEEN, _HOLE = "</w>", 1, 2, 3
#: A text that shows whether the vocabulary's own rules are those that the faster way assumes.
_PROBE = "It's we'll 'Tis don't,x-1 a1b22 ÀÉß çÑø ¿qué? 'storm \"'s he's'd $9.50 http://a.b/c_d?e=f#g !!! a'b'c 'RE 'Ve ''t 5's"
#: Classes of bytes: white space 0, letters 1 (all of Latin-1's two-byte letters), digits 2, others 3, marks 4.
_class = np.full(256, 3, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = 0
_class[97:123] = _class[128:] = 1
_class[48:58] = 2
_class[[_BETWEEN, _HOLE]] = 4


def marked(text: str) -> str:
    """A plain text in lower case, a mark and a space after each part: contractions, runs of letters, single digits, runs of others."""
    raw = np.frombuffer(text.encode().lower(), np.uint8).copy()
    high = np.flatnonzero(raw == 0xC3) + 1
    high = high[raw[high] < 0x9F]
    raw[high] += 0x20
    kind = _class[raw]
    start = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))
    follow = np.append(raw, np.zeros(3, np.uint8))
    quote = np.flatnonzero((raw == ord("'")) & start)
    one, two = follow[quote + 1], follow[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    for after in (quote[short] + 2, quote[long] + 3):
        start[after[after < len(raw)]] = True
    end = np.append(start[1:], True) & (kind > 0) & (kind < 4)
    place = np.arange(len(raw)) + 2 * (np.cumsum(end) - end)
    out = np.full(len(raw) + 2 * int(end.sum()), 32, np.uint8)
    out[place] = raw
    out[place[end] + 1] = _MARK
    return out.tobytes().decode()


class WordEncoder:
    """Ids of a whole text as bytes (little-endian unsigned 32-bit), for a word-end BPE vocabulary file.

    The vocabulary's rules never join characters across white space, so a text's ids are those of
    its words in turn. Plain Latin texts are cut by array operations as the vocabulary's pattern
    cuts them and merged by a faster library, with the word-end mark as a byte of its own whose
    merges come first; other words go to the file's own library, and so does, as a whole, a text
    that holds a special token's string or a mark's byte, and every text if a probe shows that the
    file's rules differ. Surrogates are replaced, as in UTF-8 encoding.
    """

    def __init__(self, path: str, plain: bool | None = None) -> None:
        """plain: whether the faster way fits the file's rules, where a driver has found out; the file's library is loaded when it is needed."""
        import tiktoken

        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the others are shown as chr(256), chr(257), ...
        shown = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*visible}))}
        ranks = {}
        for token, i in file["model"]["vocab"].items():
            end = token.endswith(_END)
            raw = [shown.get(c) for c in (token.removesuffix(_END) if end else token)]
            if None not in raw:
                ranks[bytes(raw) + bytes([_MARK]) * end] = i
        spare = max(ranks.values()) + 1
        for b in range(256):  # bytes that no text has need a rank too
            if bytes([b]) not in ranks:
                ranks[bytes([b])], spare = spare, spare + 1
        self.fast = tiktoken.Encoding("words", pat_str=r"[^ \t\n\x0b\x0c\r]+", mergeable_ranks=ranks, special_tokens={})
        self.between, self.hole = ranks[bytes([_BETWEEN])], ranks[bytes([_HOLE])]
        self.plain = _PLAIN
        self.plain = _PLAIN if (self.encode([_PROBE]) == self._whole([_PROBE]) if plain is None else plain) else _NEVER

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of some plain texts."""
        ids = np.array(self.fast.encode_ordinary(marked(f" {chr(_BETWEEN)} ".join(texts))), "<u4")
        at = np.flatnonzero(ids == self.between)
        for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True):
            yield ids[a:b]

    def _filled(self, ids: np.ndarray, words: list[bytes]) -> bytes:
        parts = np.split(ids, np.flatnonzero(ids == self.hole))
        return parts[0].tobytes() + b"".join(w + p[1:].tobytes() for w, p in zip(words, parts[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, held, n = [b""] * len(texts), [], 0
        for k, t in enumerate(texts):
            t = t if t.isascii() else t.encode("utf-8", "replace").decode()
            if _ODD.search(t) or any(s in t for s in self.special) or self.plain is _NEVER:
                out[k] = self._whole([t])[0]
                continue
            while t:
                cut = _SPACE.search(t, CHARS_AT_ONCE) if len(t) > CHARS_AT_ONCE else None
                now, t = (t[: cut.start()], t[cut.end() :]) if cut else (t, "")
                if held and n + len(now) > CHARS_AT_ONCE:
                    self._put(held, out)
                    held, n = [], 0
                held.append((k, now))
                n += len(now)
        self._put(held, out)
        return out

    def _put(self, held: list[tuple[int, str]], out: list[bytes]) -> None:
        """Adds the ids of (number of the text, stretch of it) to out."""
        texts, others = [], []
        for _, t in held:
            words = []
            if not self.plain.fullmatch(t):
                parts = t.split()
                words = [w for w in parts if not self.plain.fullmatch(w)]
                t = " ".join(w if self.plain.fullmatch(w) else chr(_HOLE) for w in parts)
            texts.append(t)
            others.append(words)
        ids = iter(self._whole([w for words in others for w in words]))
        for (k, _), x, words in zip(held, self._plain(texts) if texts else (), others, strict=True):
            out[k] += self._filled(x, [next(ids) for _ in words]) if words else x.tobytes()


def is_plain(path: str) -> bool:
    """Whether the faster way fits a vocabulary file: found out by the probe, on the driver."""
    return WordEncoder(path).plain is _PLAIN


def encoder(path: str, plain: bool) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, plain)
    return _encoders[path]
