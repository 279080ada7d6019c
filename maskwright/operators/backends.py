"""Configuration of model backends, checked before a job starts, and a wrapper for models that name categories of their own."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from maskwright.operators.artifacts import ArtifactRecognizer, Backend, Settings

#: Backends, and the backends that each accelerator needs.
BACKENDS = ("go", "ort", "xla")
ACCELERATORS = {"": BACKENDS, "cuda": ("ort", "xla"), "coreml": ("ort",), "directml": ("ort",)}


@dataclass(frozen=True)
class BackendConfig:
    """backend: the engine that runs a model ("" is the first). accelerator: what it runs on, with options. buckets: batch and sequence sizes to which shapes are rounded, for engines that compile."""

    backend: str = ""
    accelerator: str = ""
    options: dict[str, str] = field(default_factory=dict)
    batch_buckets: tuple[int, ...] = ()
    sequence_buckets: tuple[int, ...] = ()

    def checked(self) -> BackendConfig:
        """Itself with the names in lower case; raises ValueError for what can't work together."""
        backend, accelerator = self.backend.lower() or BACKENDS[0], self.accelerator.lower()
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend!r} (want one of {', '.join(BACKENDS)})")
        if accelerator not in ACCELERATORS:
            raise ValueError(f"unknown accelerator {self.accelerator!r} (want one of {', '.join(filter(None, ACCELERATORS))})")
        if backend not in ACCELERATORS[accelerator]:
            raise ValueError(f"accelerator {accelerator!r} requires backend {' or '.join(ACCELERATORS[accelerator])} (backend is {backend!r})")
        if accelerator == "directml" and not re.fullmatch(r"[+-]?\d+", self.options.get("device_id", "0")):
            raise ValueError(f"accelerator {accelerator!r}: invalid device_id {self.options['device_id']!r}")
        return BackendConfig(backend, accelerator, self.options, *((self.batch_buckets, self.sequence_buckets) if self.rounds(backend) else ((), ())))

    def rounds(self, backend: str) -> bool:
        """Shapes are rounded only where an engine compiles for each."""
        return backend != "ort" and bool(self.batch_buckets and self.sequence_buckets)


#: The categories of a privacy filter and their types.
FILTER_TYPES = {"private_person": "PERSON", "private_address": "LOCATION", "private_email": "EMAIL_ADDRESS", "private_phone": "PHONE_NUMBER", "private_url": "URL", "private_date": "DATE_TIME", "account_number": "ACCOUNT_NUMBER", "secret": "SECRET"}


def type_of(label: str, mapping: dict[str, str] | None = None) -> str:
    """A category's type; one that isn't mapped is its name in capitals, with underscores for hyphens."""
    known = FILTER_TYPES if mapping is None else mapping
    return known.get(label) or label.replace("-", "_").upper()


def filtering(backend: Callable[[], Backend], mapping: dict[str, str] | None = None, ignore: tuple[str, ...] = ()) -> tuple[Callable[[], Backend], Settings, ArtifactRecognizer]:
    """A model of privacy categories as a backend, its settings and the recognizer that takes its spans. ignore: categories or types to leave out."""

    def typed() -> Backend:
        model = backend()
        return lambda texts: [[(type_of(label, mapping), a, b, s) for label, a, b, s in found if label not in ignore] for found in model(texts)]

    types = sorted({t for c, t in (FILTER_TYPES if mapping is None else mapping).items() if c not in ignore and t not in ignore})
    return typed, Settings(ignore=ignore), ArtifactRecognizer(tuple(types) or None, "PrivacyFilterRecognizer")
