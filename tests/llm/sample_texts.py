"""Invented prose for tests."""

import random


def prose(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "ro", "mi", "ten", "shi", "lo", "ra", "bel", "nu", "dor", "ä", "é"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))
