"""Registered queries by family."""

from importlib import import_module

ALL = [import_module(f"gavelflow.plans.{m}") for m in ("store", "committee", "clean", "decontam", "sample", "stats", "files", "score", "convert", "records", "generate", "claims", "decisions", "streams", "packing")]
