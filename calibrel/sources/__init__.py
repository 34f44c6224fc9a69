"""Readers."""

from calibrel.sources.conversations import parse_conversations, read_conversations
from calibrel.sources.logs import read_run_logs, read_stage_logs

__all__ = ["parse_conversations", "read_conversations", "read_run_logs", "read_stage_logs"]
