"""Token ids of whole texts by a vocabulary file, with a bounded memory of words already seen.

The byte-level vocabularies used here always cut a text before a blank that stands between two other characters, and
around a single line break; so the ids of a text are the ids of such parts in a row. Parts are looked up; only new ones
are tokenized, many at a time, without the punctuation behind them, which is a token of its own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that is neither a blank nor a line break, or has white space or the end behind it.
_UNEVEN = re.compile(r"\s(?:(?<=[^ \n])|(?=\s|\Z))")
_AFTER = "!#$%&*+,-./:;<=>?@^_|~"
_LATIN = "ɐ"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. ``most_words`` bounds the memory of words.

    With ``literal``, special tokens that stand in a text are read as plain characters; without it they become their own
    ids, as the library does by default. Texts that hold such tokens are always tokenized whole.
    """

    def __init__(self, path: str, most_words: int = 1_000_000, literal: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = [t.content for t in added if not (literal and t.special)]
        self.most_words = most_words
        #: By part: one that follows a blank, without it; or a line break with what follows.
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ") or t == "Ċ"]] = True
        mixed = self.plain([" a b.\nc", " a", " b", ".", "\n", "c"])
        self.cuts = mixed[0] == b"".join(mixed[1:])

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _tokenized(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, tokenized in runs and taken apart where a token begins with the blank or is the line break."""
        found: dict[str, bytes] = {}
        odd = [p for p in parts if len(p.split()) != 1 or p[-1].isspace()]
        if odd:
            skip = set(odd)
            parts = [p for p in parts if p not in skip]
            found.update(zip(odd, self.plain([p if p[:1] == "\n" else f" {p}" for p in odd]), strict=True))
        for low in range(0, len(parts), 512):
            some = parts[low : low + 512]
            led = [p if p[0] == "\n" else f" {p}" for p in some]
            ids = np.frombuffer(self.plain(["".join(led)])[0], "<u4")
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(some) and first[0] == 0:
                raw, ends = ids.tobytes(), np.append(first[1:], len(ids)) * 4
                found.update(zip(some, (raw[a:b] for a, b in zip((first * 4).tolist(), ends.tolist(), strict=True)), strict=True))
            else:
                found.update(zip(some, self.plain(led), strict=True))
        return found

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        cores: dict[str, str] = {}
        for part in fresh:
            core = part.rstrip(_AFTER)
            if core and len(core) < len(part) and core[-1] < _LATIN and core[-1].isalnum():
                cores[part] = core
        wanted = {cores.get(part, part) for part in fresh}
        new = self._tokenized([w for w in wanted if w not in self.known])
        for part, core in cores.items():
            tail = part[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self.plain([tail])[0]
            new[part] = (new.get(core) or self.known[core]) + self.tails[tail]
        if len(self.tails) > 10_000:
            self.tails.clear()
        return new

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; none for an empty one."""
        if not self.cuts:
            return self.plain(texts)
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple] = []
        fresh: set[str] = set()
        known = self.known
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(t in text for t in self.whole):
                out[i] = self.plain([text])[0]
                continue
            if not text[0].isspace() and _UNEVEN.search(text) is None:
                head, *rest = text.replace("\n", " \n").split(" ")
            else:
                head, *rest = _CUT.split(text)
            ids = list(map(known.get, rest))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                lost = [rest[k] for k in gaps]
                fresh.update(lost)
                split.append((i, head, ids, gaps, lost))
            else:
                split.append((i, head, ids, (), ()))
        heads = self.plain([part[1] for part in split])
        new = self._learn(fresh) if fresh else {}
        for (i, _, ids, gaps, lost), head in zip(split, heads, strict=True):
            for k, part in zip(gaps, lost, strict=True):
                ids[k] = new[part]
            out[i] = head + b"".join(ids)
        room = self.most_words - len(known)
        if room > 0:
            known.update(new if len(new) <= room else dict(islice(new.items(), room)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, literal: bool) -> Encoder:
    """One encoder for a Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(path, literal=literal)
