"""Random prose of the fixtures."""

SYLL = "an be co du er fi ga ho in ka lo mi no or pa qu re si ta ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLL) for _ in range(rng.randint(1, 3))) for _ in range(n))
