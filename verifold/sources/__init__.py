"""Readers of papers, run outputs, archives and records, and writers of canonical documents."""

from .files import archive_members, artifacts, papers, record, tree_hash  # noqa: F401
from .sinks import canonical_json, documents_of, render_table, write_cases, write_objects  # noqa: F401
