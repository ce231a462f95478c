"""What the driver keeps between the steps of an operator."""

import re
from pathlib import Path

from lakecover.llm.exchange import written
from lakecover.operators.checkpoints import give_back


def _resident(spark):
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_a_step_returns_freed_native_memory(spark):
    """Compressors hold native memory in pieces that the allocator keeps when they are freed; one in eight stays, so that no arena is free to its end."""
    made = [spark.sparkContext._jvm.java.util.zip.Deflater() for _ in range(1200)]
    for i, one in enumerate(made):
        if i % 8:
            one.end()
    assert written(spark.range(3)).count() == 3
    kept = _resident(spark)
    give_back(spark)
    kept -= _resident(spark)
    for one in made[::8]:
        one.end()
    assert kept < 30
