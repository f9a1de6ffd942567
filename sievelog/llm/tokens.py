"""Token ids by the tokenizers library, at the speed of a lookup.

Both vocabularies split a text into words before they merge inside them, so the
ids of a text are those of its pieces between ASCII spaces, in order. Pieces
recur; each goes to the tokenizer once and its ids are kept as bytes. New
pieces go there many to a call, joined by spaces: the byte-level vocabulary
marks the token that starts a piece, the word vocabulary the one that ends a
word. A text whose pieces do not surely fall at word borders goes to the
tokenizer whole, so the ids always are those of the whole text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Pieces kept by a Python worker: two generations, the older dropped when the newer is full.
KEPT_PIECES = 600_000
#: Pieces joined to one text for the tokenizer.
JOINED = 200


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PLAIN = frozenset(map(chr, range(33, 127)))


def _blank(c: str) -> bool:
    return c.isspace() or unicodedata.category(c)[0] in "ZC"


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    spaces_join: a space belongs to the word after it (byte-level vocabularies);
    else white space only separates, and case is dropped.
    """

    def __init__(self, path: str, spaces_join: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces_join = spaces_join
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.border[i] = token.startswith(("Ġ", "Ċ")) if spaces_join else token.endswith("</w>")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {m: self._each([m])[0] for m in ",.;:!?"}
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        """The text cut at spaces, and before single line breaks, which are words of their own or none."""
        if not self.spaces_join:
            return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
        return (text if "\n\n" in text else text.replace("\n", " \n")).split(" ")

    def _with_space(self, p: str) -> str:
        return " " + p if self.spaces_join and p[:1] != "\n" else p

    def _many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Pieces have no blank at an end; for the word vocabulary they are letters only."""
        groups = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([("" if self.spaces_join else " ").join(map(self._with_space, g)) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.border[ids])
            if len(cuts) != len(group):
                out += self._each([self._with_space(p) for p in group])
                continue
            ends = [*(4 * cuts[1:]).tolist(), 4 * len(ids)] if self.spaces_join else (4 * cuts + 4).tolist()
            raw, at = ids.tobytes(), 0
            for end in ends:
                out.append(raw[at:end])
                at = end
        return out

    def _sure(self, p: str) -> bool:
        """Whether a word border surely lies at both ends of a piece."""
        p = p[1:] if p[:1] == "\n" else p
        return bool(p) and (p[0] in _PLAIN or not _blank(p[0])) and (p[-1] in _PLAIN or not _blank(p[-1]))

    def _find(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that the newer generation lacks; but for those without sure borders. They are kept from now on."""
        new, old, marks, late = self.new, self.old, self.marks, {}
        marked, joined, alone = [], set(), []

        def ask(p: str) -> None:
            if p in old:
                late[p] = old[p]
            elif p.isalpha() or self.spaces_join and self._sure(p) and p.find("\n", 1) < 0:
                joined.add(p)
            elif not self.spaces_join or self._sure(p):
                alone.append(p)

        for p in pieces:
            if p in old:
                late[p] = old[p]
                continue
            word, mark = (p[:-1], p[-1]) if p[-1:] in marks and p[:-1].isalpha() else (p, "")
            base = word.lower() if not self.spaces_join and word.isascii() and word.isalpha() else word
            if base is not p and base != p:  # made of a word without its mark or capitals
                marked.append((p, base, mark))
                if base in new or base in late or base in joined:
                    continue
            ask(base)
        order = list(joined)
        late.update(zip(order, self._many(order)))
        late.update(zip(alone, self._each([self._with_space(p) for p in alone])))
        for p, base, mark in marked:
            ids = late.get(base) or new[base]
            late[p] = ids + marks[mark] if mark else ids
        new.update(late)
        if len(new) > KEPT_PIECES // 2:
            self.old, self.new = new, {}
        return late

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts that hold a special token's string go to the tokenizer whole."""
        out: list[bytes] = [b""] * len(texts)
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [() if k in whole else self._pieces(t) for k, t in enumerate(texts)]
        get = self.new.get
        found = [list(map(get, pieces)) for pieces in split]
        holes = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        missing = list({pieces[i] for pieces, at in zip(split, holes) for i in at})
        late: dict[str, bytes] = {}
        for at in range(0, len(missing), KEPT_PIECES // 8):
            late.update(self._find(set(missing[at : at + KEPT_PIECES // 8])))
        heads = []
        for k, (pieces, ids, at) in enumerate(zip(split, found, holes)):
            if k in whole:
                continue
            for i in at:
                ids[i] = late.get(pieces[i])
            if not self.spaces_join:
                out[k] = b"".join(ids)
                continue
            # the first piece has no space before it; a piece without sure borders sends the text to the tokenizer
            ids[0] = b""
            try:
                out[k] = b"".join(ids)
            except TypeError:
                whole.add(k)
                continue
            if len(pieces) > 1 and pieces[0][:1] != "\n" and self._sure(pieces[0]):
                heads.append(k)
            else:
                whole.add(k)
        for k, ids in zip(heads, self._each([split[k][0] for k in heads])):
            out[k] = ids + out[k]
        rest = sorted(whole)
        for k, ids in zip(rest, self._each([texts[k] for k in rest])):
            out[k] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces_join: bool) -> Encoder:
    """One per Python worker and vocabulary."""
    if (path, spaces_join) not in _encoders:
        _encoders[path, spaces_join] = Encoder(path, spaces_join)
    return _encoders[path, spaces_join]
