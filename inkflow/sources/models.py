"""Models behind the stages. A scorer is any callable on NumPy arrays, so tests need no model file."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from types import ModuleType

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Runtime providers by the engine's name for a device.
PROVIDERS = {
    "cpu": "CPUExecutionProvider", "cuda": "CUDAExecutionProvider", "tensorrt": "TensorrtExecutionProvider",
    "directml": "DmlExecutionProvider", "coreml": "CoreMLExecutionProvider", "openvino": "OpenVINOExecutionProvider",
}


def _opened() -> dict:
    """The sessions of this process. A global of this module won't do: it goes to the workers by value with every task."""
    name = "_inkflow_sessions"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__.setdefault("sessions", {})


def session(path: str, device: str = "cpu", options: dict | None = None):
    """A runtime session, opened once in each Python worker; it uses one thread, as Spark runs a task for each core."""
    if device not in PROVIDERS:
        raise ValueError(f"device must be one of {', '.join(PROVIDERS)}, not {device!r}")
    key = path, device, tuple(sorted((options or {}).items()))
    opened = _opened()
    if key not in opened:
        import onnxruntime as ort

        how = ort.SessionOptions()
        how.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        how.enable_cpu_mem_arena, how.enable_mem_pattern = True, False
        how.intra_op_num_threads = 1
        opened[key] = ort.InferenceSession(path, how, providers=[(PROVIDERS[device], options or {}), PROVIDERS["cpu"]] if device != "cpu" else [PROVIDERS["cpu"]])
    return opened[key]


@dataclass(frozen=True)
class OnnxScorer:
    """A model file as a scorer: one input tensor to the first output tensor.

    ``options`` are the device's, as the runtime names them, for example ``(("device_id", "1"),)``."""

    path: str
    device: str = "cpu"
    options: tuple[tuple[str, str], ...] = ()
    sent: bool = False

    def shipped(self, spark: SparkSession) -> OnnxScorer:
        """The same scorer after Spark has been told to copy the file to every executor."""
        spark.sparkContext.addFile(self.path)
        return replace(self, path=os.path.basename(self.path), sent=True)

    def __call__(self, tensor: np.ndarray) -> np.ndarray:
        own = session(SparkFiles.get(self.path) if self.sent else self.path, self.device, dict(self.options))
        return own.run(None, {own.get_inputs()[0].name: tensor})[0]


@dataclass(frozen=True)
class Scorers:
    """detect: (1, 3, h, w) to (1, 1, h, w); classify: (n, 3, h, w) to (n, 2), or None for no such stage;
    recognize: (n, 3, h, w) to (n, steps, classes).

    ``prepare`` makes the detector's tensor of a scaled image, and ``find`` boxes with scores of its map, the
    image's width and height and the detector's configuration; None for the engine's own."""

    detect: Callable[[np.ndarray], np.ndarray]
    recognize: Callable[[np.ndarray], np.ndarray]
    classify: Callable[[np.ndarray], np.ndarray] | None = None
    prepare: Callable[[np.ndarray], np.ndarray] | None = None
    find: Callable[..., list[tuple[np.ndarray, float]]] | None = None


def alphabet(characters: str) -> list[str]:
    """Entries of a recogniser, from its metadata: one a line, with the blank before and a space after them."""
    return ["blank", *characters.split("\n"), " "]


def alphabet_of_model(path: str) -> list[str]:
    """The alphabet that a model file brings along."""
    found = session(path).get_modelmeta().custom_metadata_map.get("character")
    if found is None:
        raise ValueError(f"{path} has no alphabet")
    return alphabet(found)
