"""Mass spectra from mzML files, decoded in the tasks that read them."""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Controlled-vocabulary accessions used here (fixed values).
MS_LEVEL, SCAN_START, SELECTED_MZ, CHARGE = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000041"
MZ_ARRAY, INTENSITY_ARRAY, DOUBLE_BITS, ZLIB = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574"

SCHEMA = "path string, scan int, ms_level int, rt double, precursor_mz double, charge int, mz array<float>, intensity array<float>"


def _spectra(path: str, content: bytes) -> Iterator[tuple]:
    scan = 0
    for _, node in ElementTree.iterparse(io.BytesIO(content), events=("end",)):
        if node.tag.rpartition("}")[2] != "spectrum":
            continue
        scan += 1
        values: dict[str, str] = {}
        arrays: dict[str, np.ndarray] = {}
        for part in node.iter():
            name = part.tag.rpartition("}")[2]
            if name == "cvParam":
                values.setdefault(part.get("accession", ""), part.get("value", ""))
            elif name == "binaryDataArray":
                kinds = {p.get("accession") for p in part.iter() if p.tag.endswith("cvParam")}
                text = next((p.text or "" for p in part.iter() if p.tag.endswith("binary")), "")
                raw = base64.b64decode(text)
                raw = zlib.decompress(raw) if ZLIB in kinds and raw else raw
                data = np.frombuffer(raw, "<f8" if DOUBLE_BITS in kinds else "<f4").astype(np.float32)
                for kind in (MZ_ARRAY, INTENSITY_ARRAY):
                    if kind in kinds:
                        arrays[kind] = data
        number = lambda key, cast: cast(float(values[key])) if values.get(key) else None
        start = number(SCAN_START, float)
        yield (
            path,
            scan,
            number(MS_LEVEL, int) or 1,
            start * 60 if start is not None else None,
            number(SELECTED_MZ, float),
            number(CHARGE, int),
            arrays.get(MZ_ARRAY, np.zeros(0, np.float32)).tolist(),
            arrays.get(INTENSITY_ARRAY, np.zeros(0, np.float32)).tolist(),
        )
        node.clear()


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row a spectrum; scans are numbered in file order, times are in seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = list(_spectra(name, content))
                frame = pd.DataFrame(rows, columns=columns)
                for c in ("scan", "ms_level", "charge"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mz[Mm][Ll]").option("recursiveFileLookup", "false").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def clean_peaks(spectra: DataFrame, least: float = 0.01) -> DataFrame:
    """Peaks of at least ``least`` of the base peak, by m/z, scaled to it."""
    base = F.array_max("intensity")
    pairs = F.arrays_zip(F.col("mz"), F.col("intensity"))
    kept = F.array_sort(F.filter(pairs, lambda p: p["intensity"] >= least * base))
    return spectra.withColumn("_p", kept).withColumn("mz", F.col("_p.mz")).withColumn("intensity", F.transform("_p.intensity", lambda i: (i / base).cast("float"))).drop("_p")
