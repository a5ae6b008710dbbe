"""Made-up texts."""

from __future__ import annotations

import random

WORDS = "the of and to in that is was for on with as by at from this have or an be ist der die das und la le de en que".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er", "tion"]) for _ in range(n))
