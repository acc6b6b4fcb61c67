"""Recordings as a stream: clips are played in short chunks, as they would come from a microphone, from wherever a restart finds them."""

from __future__ import annotations

import os
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "clip string, n long, seconds double, rms double, peak double, ended boolean"
#: Milliseconds of a chunk, and chunks of a clip that a micro-batch holds.
CHUNK_MS, CHUNKS = 20, 500


class Part(InputPartition):
    """Chunks of one clip, from one number up to another."""

    def __init__(self, path: str, first: int, end: int):
        super().__init__(None)
        self.path, self.first, self.end = path, first, end


def clips(folder: str) -> list[str]:
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.lower().endswith(".wav"))


def length(path: str, ms: int) -> int:
    """Chunks of a clip; the last may be shorter."""
    with wave.open(path) as w:
        return -(-w.getnframes() // max(1, w.getframerate() * ms // 1000))


def chunks(path: str, first: int, end: int, ms: int) -> Iterator[tuple]:
    """Rows of a clip's chunks; only these are read. Samples have 16 bits, channels are averaged."""
    with wave.open(path) as w:
        size, channels = max(1, w.getframerate() * ms // 1000), w.getnchannels()
        if w.getsampwidth() != 2:
            raise ValueError(f"{path}: samples of 16 bits are needed")
        total = -(-w.getnframes() // size)
        w.setpos(min(first * size, w.getnframes()))
        for n in range(first, min(end, total)):
            samples = np.frombuffer(w.readframes(size), "<i2").reshape(-1, channels).mean(axis=1) / 32768
            yield os.path.basename(path), n, len(samples) / w.getframerate(), float(np.sqrt(np.square(samples).mean())), float(np.abs(samples).max()), n == total - 1


class Reader(DataSourceStreamReader):
    """The offset is how many chunks of every clip were played; a micro-batch plays as many of each, a clip a partition."""

    def __init__(self, options: dict):
        self.folder, self.ms, self.most = options["path"], int(options.get("chunkMs", CHUNK_MS)), int(options.get("chunksPerBatch", CHUNKS))
        self.played: int | None = None

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def latestOffset(self) -> dict:
        if self.played is None:
            self.played = 0
        longest = max((length(p, self.ms) for p in clips(self.folder)), default=0)
        self.played = min(self.played + self.most, longest)
        return {"chunk": self.played}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.played = max(self.played or 0, end["chunk"])  # after a restart the next batch goes on from here
        return [Part(p, start["chunk"], min(end["chunk"], n)) for p in clips(self.folder) if (n := length(p, self.ms)) > start["chunk"]]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from chunks(partition.path, partition.first, partition.end, self.ms)


class ClipReplay(DataSource):
    """format("clips"), option path: a folder of wave files that every executor can read; chunkMs, chunksPerBatch. Register with spark.dataSource.register(ClipReplay)."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(dict(self.options))
