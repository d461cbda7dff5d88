"""A bounded memory of words and what was worked out for them."""

from __future__ import annotations

REMEMBERED = 250_000    # words in each of two generations
LONGEST = 48            # longer words are worked out anew each time


class WordMemory(dict):
    """Looks words up like a dict; what is missing is worked out and remembered.

    A full generation becomes the old one, whose words move up again when they are seen; the
    generation before is forgotten.  So memory is bounded and frequent words stay.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def work_out(self, word: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.work_out(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found
