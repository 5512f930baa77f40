from pathlib import Path

from quarry.llm.common import cut, forget


def resident_mb(jvm):
    return int(Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read_text().split()[1]) * 4096 / 1e6


def test_freed_native_memory_of_the_driver_goes_back_to_the_system(spark):
    jvm = spark.sparkContext._jvm
    for back in (lambda: cut(spark.range(10)), lambda: forget(spark)):
        for _ in range(3):  # what is loaded and compiled at first takes memory too
            back()
        before = resident_mb(jvm)
        # Each holds some 256 KB of native memory; the last one keeps the allocator from shrinking by itself.
        held = [jvm.java.util.zip.Deflater() for _ in range(2000)]
        for x in held[:-1]:
            x.end()
        freed = resident_mb(jvm)
        back()
        after = resident_mb(jvm)
        held[-1].end()
        assert freed - after > 30, (before, freed, after)
