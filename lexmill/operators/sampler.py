"""A sampler that goes through a table in seeded orders, epoch by epoch, and goes on where it stopped."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split import permutation, permuted


@dataclass
class Sampler:
    """``seed`` fixes the orders; (``epoch``, ``offset``) is the next item's place; ``fingerprint`` says of which data it is."""

    size: int
    seed: int
    fingerprint: str = ""
    epoch: int = 0
    offset: int = 0

    def take(self, spark: SparkSession, n: int) -> DataFrame:
        """(turn, epoch, place, item) of the next ``n`` items, over the ends of epochs where need be; moves on.

        One epoch is an affine permutation of a range, so nothing is sorted and every place is worked out where it is used.
        """
        if self.size < 1:
            raise ValueError("there is nothing to sample")
        out, turn = None, 0
        while turn < n or out is None:
            step = min(n - turn, self.size - self.offset)
            a, b = permutation(self.size, self.seed, self.epoch)
            part = permuted(spark, self.size, a, b, self.offset).where(F.col("place") < self.offset + step)
            part = part.select((F.col("place") + (turn - self.offset)).alias("turn"), F.lit(self.epoch).alias("epoch"), "place", "item")
            out = part if out is None else out.unionByName(part)
            turn, self.offset = turn + step, self.offset + step
            if self.offset == self.size:
                self.epoch, self.offset = self.epoch + 1, 0
            if n == 0:
                break
        return out

    def left(self) -> int:
        """Items of this epoch that are still to come."""
        return self.size - self.offset

    def state(self) -> dict:
        return asdict(self)

    def load(self, state: dict | None) -> bool:
        """Goes on from a saved state and says whether it did. Data that has changed since begins anew, with this sampler's
        own seed and size; another seed or a place outside the table is an error."""
        if not state:
            return False
        if state.get("fingerprint", "") != self.fingerprint or state.get("size", self.size) != self.size:
            self.epoch = self.offset = 0
            return False
        if state["seed"] != self.seed:
            raise ValueError(f"the state is of seed {state['seed']}, not {self.seed}")
        if not 0 <= state["offset"] <= self.size:
            raise ValueError(f"place {state['offset']} is outside of {self.size} items")
        self.epoch, self.offset = state["epoch"], state["offset"]
        return True


def sampled(df: DataFrame, sampler: Sampler, n: int, place: str) -> DataFrame:
    """The next ``n`` rows of ``df`` with turn and epoch; ``place`` numbers its rows from 0 on. A row may come once an epoch."""
    drawn = sampler.take(df.sparkSession, n).select("turn", "epoch", F.col("item").alias(place))
    return df.join(drawn, place)
