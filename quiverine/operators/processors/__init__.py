"""From raw payloads to embeddings, one module for each kind of input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from quiverine.config import Modality
from quiverine.errors import VectorEngineError

from . import audio, image, tabular, text, timeseries

#: A processor makes an embedding column of a binary column.
Processor = Callable[[Column], Column]


class ProcessorRegistry:
    """The standard processors and any others by modality or name."""

    def __init__(self) -> None:
        self.processors: dict[Modality | str, Processor] = {
            Modality.TEXT: text.process, Modality.IMAGE: image.process, Modality.AUDIO: audio.process,
            Modality.VIDEO: image.process_video, Modality.TABULAR: tabular.process, Modality.TIME_SERIES: timeseries.process,
        }
        self.validators: dict[Modality | str, Processor] = {Modality.TEXT: text.is_valid, Modality.IMAGE: image.is_valid, Modality.AUDIO: audio.is_valid}

    def register(self, kind: Modality | str, processor: Processor, validator: Processor | None = None) -> None:
        if not callable(processor):
            raise VectorEngineError("a processor must be callable")
        self.processors[kind] = processor
        if validator:
            self.validators[kind] = validator

    def process(self, kind: Modality | str, raw: Column) -> Column:
        if kind not in self.processors:
            raise VectorEngineError(f"no processor for {kind}")
        return self.processors[kind](raw)

    def validate(self, kind: Modality | str, raw: Column) -> Column:
        from pyspark.sql import functions as F

        check = self.validators.get(kind)
        return check(raw) if check else F.octet_length(raw) > 0
