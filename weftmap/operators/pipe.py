"""Custom steps over chunks of pixels: a thin layer over mapInPandas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame

Step = tuple[Callable, tuple, dict]


class ChunkPipe:
    """Steps applied to every chunk of a table by the executors. ``prepare`` makes a state from a chunk that each later step
    gets before its chunk; steps are added without changing the pipe they are added to."""

    def __init__(self, frame: DataFrame, init: Callable | None = None, steps: tuple[Step, ...] = ()):
        self.frame, self.init, self.steps = frame, init, steps

    def prepare(self, init: Callable) -> ChunkPipe:
        return ChunkPipe(self.frame, init, self.steps)

    def pipe(self, step: Callable, *args, **kwargs) -> ChunkPipe:
        return ChunkPipe(self.frame, self.init, (*self.steps, (step, args, kwargs)))

    def _function(self):
        init, steps = self.init, self.steps

        def run(batches):
            for chunk in batches:
                if init is None:
                    for step, args, kwargs in steps:
                        chunk = step(chunk, *args, **kwargs)
                else:
                    origin, chunk = chunk, init(chunk)
                    for step, args, kwargs in steps:
                        chunk = step(origin, chunk, *args, **kwargs)
                yield chunk

        return run

    def table(self, schema: str) -> DataFrame:
        """The results, each a pandas frame of this schema, as one table."""
        return self.frame.mapInPandas(self._function(), schema)

    def _pickled(self, results: Callable):
        """Whatever ``results`` yields from all chunks' results of a task, on the driver, one after another."""
        import pickle

        run = self._function()

        def packed(batches):
            import pandas as pd
            from pyspark import cloudpickle

            for x in results(run(batches)):
                yield pd.DataFrame({"x": [cloudpickle.dumps(x)]})

        return (pickle.loads(r["x"]) for r in self.frame.mapInPandas(packed, "x binary").toLocalIterator())

    def gather(self) -> list:
        """The results of all chunks, of any kind, on the driver."""
        return list(self._pickled(lambda results: results))

    def reduce(self, op: Callable, init, merge: Callable | None = None):
        """The results folded by ``op`` from ``init`` on. With ``merge``, which joins two folded values, every task folds its own chunks first, and
        the driver sees a value a task; without it results are folded on the driver as they come, and none is kept."""
        if merge is None:
            return fold(op, self._pickled(lambda results: results), init)
        return fold(merge, self._pickled(lambda results: [fold(op, results, init)]), init)


def split(frame: DataFrame) -> ChunkPipe:
    return ChunkPipe(frame)
