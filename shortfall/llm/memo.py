"""A bounded memo of words for tokenizers that never join what white space parts."""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable, Sequence
from types import ModuleType
from typing import Any

from shortfall.llm.common import by_value

by_value(__name__)

MEMO_BYTES = 160 << 20
MEMO_WORD = 64  # longer words are encoded each time
ENTRY_BYTES = 170  # of a word in memory, besides its letters and its value


class Memo:
    """What `encode` gives for words, each distinct one encoded once while the memo holds it.

    All new words of a call are encoded together. The memo has two halves: when the younger one is full, the
    older one is dropped, and words that are met again move to the younger one. `weigh` gives the bytes of a
    value.
    """

    def __init__(self, encode: Callable[[list], list], weigh: Callable[[Any], int], most: int = MEMO_BYTES):
        self.encode, self.weigh, self.most = encode, weigh, most
        self.young: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}
        self.size = 0

    def keep(self, words: Sequence, values: Sequence) -> None:
        self.young.update(zip(words, values, strict=True))
        self.size += ENTRY_BYTES * len(words) + sum(map(len, words)) + sum(map(self.weigh, values))

    def __call__(self, texts: Sequence[Sequence]) -> list[list]:
        """Values of the words of each text."""
        if 2 * self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        known, old = self.young, self.old
        unseen = [w for w in set().union(*texts) if w not in known]
        again = [w for w in unseen if w in old]
        if again:
            self.keep(again, [old[w] for w in again])
        new = [w for w in unseen if w not in old] if again else unseen
        found = self.encode(new) if new else []
        if max(map(len, new), default=0) <= MEMO_WORD:
            self.keep(new, found)
            return [[known[w] for w in words] for words in texts]
        lasting = [i for i, w in enumerate(new) if len(w) <= MEMO_WORD]
        self.keep([new[i] for i in lasting], [found[i] for i in lasting])
        here = dict(zip(new, found, strict=True))
        return [[known[w] if w in known else here[w] for w in words] for words in texts]


def of_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a worker process makes once and keeps for all its tasks."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def file_digest(path: str) -> str:
    """Names a vocabulary by its content, so that a worker does not take one for another."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def fast_tokenizer(model: str):
    """A tokenizer of a .json file for one task: one thread, whole texts."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    fast = Tokenizer.from_file(model)
    fast.no_truncation()
    fast.no_padding()
    return fast
