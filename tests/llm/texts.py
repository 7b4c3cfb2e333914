"""Generated texts for the tests."""

import random

WORDS = ["the", "of", "tion", "heren", "oned", "Édu", "stand", "ing,", "re.", "ouble", "ande", "ble", "thnd", "was", "sher"]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["th", "er", "on", "an", "re", "é", "st"]) for _ in range(rng.randint(1, 5)))
        out.append(w + ("\n" if i % 17 == 16 else " "))
    return "".join(out).strip()
