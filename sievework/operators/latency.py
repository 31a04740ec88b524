"""Latency of single predictions, measured in a process of its own."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from collections.abc import Callable, Sequence

from sievework.sources.documents import SourceError

WARMUPS, REPEATS = 16, 3


def timed(predict: Callable[[str], object], texts: Sequence[str], warmups: int = WARMUPS, repeats: int = REPEATS) -> dict[str, object]:
    """Milliseconds of each prediction, one text at a time, after some that aren't counted."""
    if not texts:
        raise SourceError("benchmark_without_texts")
    for i in range(warmups):
        predict(texts[i % len(texts)])
    out = []
    for _ in range(repeats):
        for text in texts:
            began = time.perf_counter_ns()
            predict(text)
            out.append((time.perf_counter_ns() - began) / 1e6)
    return {"latencies_ms": out, "peak_bytes": peak_bytes()}


def peak_bytes() -> int:
    """The largest resident size of this process so far."""
    import resource

    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return peak if sys.platform == "darwin" else peak * 1024


def in_subprocess(program: str, timeout: float = 600) -> dict[str, object]:
    """What a Python program prints as one JSON object, run in a fresh process, with the seconds it took."""
    began = time.perf_counter()
    try:
        run = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=timeout, check=True)
        found = json.loads(run.stdout.strip().splitlines()[-1])
    except (OSError, subprocess.SubprocessError, ValueError, IndexError) as error:
        raise SourceError("benchmark_failed") from error
    return {**found, "process_seconds": time.perf_counter() - began}
