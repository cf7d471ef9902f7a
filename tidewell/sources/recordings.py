"""Recordings in the European Data Format as a Spark source and sink: spark.read.format("recordings").

A file is a header in fixed ASCII fields, a header for each signal, and data records of equal length with 16-bit samples, so that any
range of records is a range of bytes. The source plans partitions of records from the headers, and reads of each file only the header
and the bytes of the seconds that are asked for. Rows: path, record, channel, start_time, rate, samples (in physical units).

Options: path (a folder or file), start and stop (seconds from a recording's begin), channels (comma-separated), records (of a
partition). Files are opened by pyarrow, wherever it can.
"""

from __future__ import annotations

import math

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, record bigint, channel string, start_time double, rate double, samples array<double>"
#: Widths of the fixed fields of the format, in order (fixed values).
FILE_FIELDS = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4))
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def header(read) -> dict:
    """The header, by a function that reads the next n bytes."""
    out = {n: read(w).decode("ascii", "replace").strip() for n, w in FILE_FIELDS}
    k = int(out["signals"])
    for n, w in SIGNAL_FIELDS:
        out[f"s_{n}"] = [read(w).decode("ascii", "replace").strip() for _ in range(k)]
    out["counts"] = [int(x) for x in out["s_samples"]]
    return out


def written_header(labels: list[str], counts: list[int], low: float, high: float, records: int, duration: float, patient: str) -> bytes:
    """A header for signals with one range of values."""
    k = len(labels)
    own = {"version": "0", "patient": patient, "date": "01.01.00", "time": "00.00.00", "bytes": str(256 * (k + 1)), "records": str(records), "duration": f"{duration:g}", "signals": str(k)}
    each = {"label": labels, "low": [f"{low:g}"] * k, "high": [f"{high:g}"] * k, "digital_low": ["-32768"] * k, "digital_high": ["32767"] * k, "samples": [str(c) for c in counts]}
    out = "".join(own.get(n, "")[:w].ljust(w) for n, w in FILE_FIELDS) + "".join(x[:w].ljust(w) for n, w in SIGNAL_FIELDS for x in each.get(n, [""] * k))
    return out.encode("ascii", "replace")


class Records(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.stop = float(options.get("start", 0)), float(options.get("stop", "inf"))
        self.channels = [c.strip() for c in options["channels"].split(",")] if options.get("channels") else None
        self.records = int(options.get("records", 1000))

    def partitions(self) -> list[InputPartition]:
        """Ranges of records; a file's header alone is read, the first 256 bytes of it."""
        from pyarrow import fs

        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        out: list[InputPartition] = []
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".edf")), key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                own = {n: file.read(w).decode("ascii", "replace").strip() for n, w in FILE_FIELDS}
            n, seconds = int(own["records"]), float(own["duration"])
            first = max(0, math.floor(self.start / seconds)) if seconds else 0
            last = n if math.isinf(self.stop) or not seconds else min(n, math.ceil(self.stop / seconds))
            out += [Records(f.path, a, min(a + self.records, last)) for a in range(first, last, self.records)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records):
        import numpy as np
        import pyarrow as pa

        if not partition.path:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as file:
            h = header(file.read)
            per, seconds = sum(h["counts"]), float(h["duration"])
            file.seek(int(h["bytes"]) + partition.first * per * 2)
            data = np.frombuffer(file.read((partition.last - partition.first) * per * 2), "<i2").reshape(-1, per)
        ends = np.cumsum(h["counts"]).tolist()
        for k, label in enumerate(h["s_label"]):
            if self.channels and label not in self.channels:
                continue
            low, high, d_low, d_high = (float(h[f"s_{x}"][k]) for x in ("low", "high", "digital_low", "digital_high"))
            values = (data[:, ends[k] - h["counts"][k] : ends[k]] - d_low) * ((high - low) / (d_high - d_low)) + low
            record = np.arange(partition.first, partition.first + len(data))
            n = h["counts"][k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(data)), pa.array(record), pa.array([label] * len(data)), pa.array(record * seconds), pa.array(np.full(len(data), n / seconds if seconds else 0.0)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * n), pa.array(values.ravel()))],
                ["path", "record", "channel", "start_time", "rate", "samples"])


class Writer(DataSourceWriter):
    """Rows (recording, record, samples) in order of both, a recording in one task -> a file of one signal for each recording, -32768 to 32767 in units of `unit`."""

    def __init__(self, options: dict):
        self.path, self.seconds, self.unit, self.label = options["path"], float(options.get("duration", 1)), float(options.get("unit", 1)), options.get("label", "EEG")

    def write(self, rows):
        import numpy as np

        store, path = opened(self.path)
        store.create_dir(path)
        name, held = None, []

        def close():
            if name is not None:
                with store.open_output_stream(f"{path}/{name}.edf") as file:
                    file.write(written_header([self.label], [len(held[0])], -32768 * self.unit, 32767 * self.unit, len(held), self.seconds, name))
                    for x in held:
                        file.write(np.rint(np.array(x) / self.unit).astype("<i2").tobytes())

        for r in rows:
            if r["recording"] != name:
                close()
                name, held = r["recording"], []
            held.append(r["samples"])
        close()
        return WriterCommitMessage()


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)
