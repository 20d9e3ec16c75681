"""java.util.Random's integers, so that seeded samples are those of any JVM program."""

from __future__ import annotations


class JavaRandom:
    # The linear congruential generator of java.util.Random.
    A, C, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1

    def __init__(self, seed: int):
        self.state = (seed ^ self.A) & self.MASK

    def _bits(self, n: int) -> int:
        self.state = (self.state * self.A + self.C) & self.MASK
        return self.state >> (48 - n)

    def below(self, n: int) -> int:
        """0 .. n - 1, as nextInt(n)."""
        if n < 1:
            raise ValueError("n must be positive")
        if n & (n - 1) == 0:
            return n * self._bits(31) >> 31
        while True:
            r = self._bits(31)
            if r - r % n + n - 1 < 1 << 31:
                return r % n


def sample_rows(n: int, size: int, seed: int = 0) -> list[int]:
    """size row numbers below n, with replacement."""
    random = JavaRandom(seed)
    return [random.below(n) for _ in range(size)]
