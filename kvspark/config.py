"""Options of a store and of its reads, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MIB = 1 << 20
RUN_MODES = ("normal", "read_only", "fallback")
COMPRESSIONS = ("none", "snappy", "lz4", "zstd")
#: Those that set_options() changes on an open store.
MUTABLE = {"min_blob_size", "blob_file_compression", "blob_file_discardable_ratio", "blob_run_mode"}


@dataclass(frozen=True)
class Options:
    dirname: str = "blobs"
    disable_background_gc: bool = False
    max_background_gc: int = 1
    purge_obsolete_files_period_sec: int = 10
    stats_dump_period_sec: int = 600
    min_blob_size: int = 4096
    blob_file_compression: str = "none"
    blob_file_target_size: int = 256 * MIB
    max_gc_batch_size: int = 1024 * MIB
    min_gc_batch_size: int = 512 * MIB
    blob_file_discardable_ratio: float = 0.5
    merge_small_file_threshold: int = 8 * MIB
    blob_run_mode: str = "normal"
    level_merge: bool = False
    range_merge: bool = False
    max_sorted_runs: int = 20
    skip_value_in_compaction_filter: bool = False
    block_size: int = 4096
    enable_punch_hole_gc: bool = False
    dynamic_level_bytes: bool = True
    num_levels: int = 7

    def __post_init__(self):
        if self.blob_run_mode not in RUN_MODES:
            raise ValueError(f"blob_run_mode: one of {RUN_MODES}, not {self.blob_run_mode!r}")
        if self.blob_file_compression not in COMPRESSIONS:
            raise ValueError(f"blob_file_compression: one of {COMPRESSIONS}, not {self.blob_file_compression!r}")
        if not 0 <= self.blob_file_discardable_ratio <= 1:
            raise ValueError("blob_file_discardable_ratio lies between 0 and 1")
        if self.level_merge and not self.dynamic_level_bytes:
            raise ValueError("level_merge needs dynamic_level_bytes")

    def set_options(self, **new: str | int | float) -> Options:
        """A copy with mutable options changed; values may be strings.  Others are refused."""
        if odd := set(new) - MUTABLE:
            raise ValueError(f"can't be changed on an open store: {sorted(odd)}")
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: kinds[k](v) for k, v in new.items()})


@dataclass(frozen=True)
class ReadOptions:
    snapshot: int | None = None
    key_only: bool = False
    abort_on_failure: bool = True
    lower_bound: bytes | None = None
    upper_bound: bytes | None = None
