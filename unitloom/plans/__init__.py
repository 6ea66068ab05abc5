"""Registered queries; importing this package fills the registry."""

from . import built, cleaning, extraction, retrieval  # noqa: F401
