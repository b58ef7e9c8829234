"""Importing the modules fills the registry."""

from . import REGISTRY, labels, learned, requests, scores, text

__all__ = ["REGISTRY", "labels", "learned", "requests", "scores", "text"]
