"""Canonical values and scalar functions as Column expressions."""

from .values import *  # noqa: F403
