"""Corpus-to-batches data preparation and run-log analysis as Spark jobs."""

from shardloom.functions.names import shard_name
from shardloom.functions.schedule import learning_rate
from shardloom.functions.splits import assign_split
from shardloom.functions.tokenizers import BpeTokenizer, ByteTokenizer
from shardloom.operators.offsets import apply_budget, split_totals, token_offsets, tokenize
from shardloom.operators.packing import pack_documents, pack_shards
from shardloom.operators.runlog import interval_loss, latest_losses, run_bounds, validation_curve
from shardloom.operators.runlog import trim as trim_metrics
from shardloom.operators.windows import batches, export_batches, token_windows
from shardloom.plans.epochs import EpochOrder, batch_ordinals, batches_in_order, epoch_plan, shard_layout, total_plan
from shardloom.plans.state import LoaderState, loader_state, resume_from, resume_order
from shardloom.plans.steps import step_plan
from shardloom.sources.dataset import prepare_dataset, write_dataset
from shardloom.sources.metrics import append_metrics, read_metrics, sync_metrics
from shardloom.sources.shards import batch_stream, read_batches, read_shards, validate_shards

__all__ = [
    "BpeTokenizer", "ByteTokenizer", "EpochOrder", "LoaderState", "append_metrics", "apply_budget", "assign_split",
    "batch_ordinals", "batch_stream", "batches", "batches_in_order", "epoch_plan", "export_batches", "interval_loss",
    "latest_losses", "learning_rate", "loader_state", "pack_documents", "pack_shards", "prepare_dataset", "read_batches",
    "read_metrics", "read_shards", "resume_from", "resume_order", "run_bounds", "shard_layout", "shard_name", "split_totals",
    "step_plan", "sync_metrics", "token_offsets", "token_windows", "tokenize", "total_plan", "trim_metrics", "validate_shards",
    "validation_curve", "write_dataset",
]
