"""What a sort run is asked to do."""

from __future__ import annotations

from dataclasses import dataclass

#: Strategies that need a power of two of parts, and rows that divide evenly.
POWER_OF_TWO = {"mergesort", "lbmergesort", "lbkmergesort", "bitonicsort", "quicksort", "bucketsort"}
EVEN_SHARES = {"mergesort", "kmerge", "bitonicsort"}


@dataclass(frozen=True)
class SortSpec:
    """n parts, m rows, seed, strategy and its parameters (stencil mapping, fan-in, unused)."""

    algo: str = "samplesort"
    n: int = 8
    m: int | None = None
    seed: int = 1
    sigma: tuple[int, int, int] = (0, 4, 0)
    strict: bool = False

    def checked(self, known: set[str]) -> SortSpec:
        """Itself, or a ValueError: before any job runs."""
        if self.algo not in known:
            raise ValueError(f"unknown strategy {self.algo!r}")
        if self.n < 1:
            raise ValueError("n must be at least 1")
        if self.m is not None and self.m < self.n and self.strict:
            raise ValueError(f"{self.m} rows are fewer than {self.n} parts")
        if self.strict:
            if self.algo in POWER_OF_TWO and self.n & (self.n - 1):
                raise ValueError(f"{self.algo} needs a power of two of parts")
            if self.algo in EVEN_SHARES and self.m is not None and self.m % self.n:
                raise ValueError(f"{self.algo} needs rows that divide evenly among parts")
            if self.algo == "sequential1" and self.n < 2:
                raise ValueError("sequential1 needs two parts")
            if self.algo == "kmerge":
                k, active = self.sigma[1], self.n
                if k < 2:
                    raise ValueError("kmerge needs a fan-in of two or more")
                while active >= k:
                    if active % k:
                        raise ValueError(f"{active} active parts cannot be merged {k} by {k}")
                    active //= k
        return self
