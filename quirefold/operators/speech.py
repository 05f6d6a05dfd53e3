"""Speech synthesis as a plug-in: an engine turns text into samples; paragraphs are synthesised where they are, and a
document's audio is their samples in order, without silence between.

Audio in a DataFrame is 16-bit little-endian PCM as bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import text as T

RATE = 24_000


class Engine(Protocol):
    sample_rate: int

    def generate(self, text: str) -> np.ndarray: ...


class ToneEngine:
    """A stand-in without a model: a tone of a length that follows the text. It is deterministic."""

    def __init__(self, sample_rate: int = RATE, samples_per_char: int = 24):
        self.sample_rate, self.pace = sample_rate, samples_per_char

    def generate(self, text: str) -> np.ndarray:
        n = len(text) * self.pace
        return 0.1 * np.sin(np.arange(n, dtype=np.float32) * (2 * np.pi * 440 / self.sample_rate))


class SegmentEngine:
    """An engine around a pipeline that yields samples for each segment, such as Kokoro's."""

    def __init__(self, pipeline: Callable | None = None, voice: str = "af_heart", speed: float = 1.0, sample_rate: int = RATE):
        if pipeline is None:
            from kokoro import KPipeline  # not installed everywhere; a pipeline can be given instead

            pipeline = KPipeline(lang_code=voice[0])
        self.pipeline, self.voice, self.speed, self.sample_rate = pipeline, voice, speed, sample_rate

    def generate(self, text: str) -> np.ndarray:
        parts = [np.asarray(audio, dtype=np.float32) for *_, audio in self.pipeline(text, voice=self.voice, speed=self.speed, split_pattern=r"\n+")]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)


# Model sizes of the voice engine; an unknown size is the small one.
VOICE_MODELS = {"0.6b": "Qwen/Qwen3-TTS-12Hz-0.6B-CustomVoice", "1.7b": "Qwen/Qwen3-TTS-12Hz-1.7B-CustomVoice"}


class VoiceEngine:
    """An engine around a model with speakers and languages. The sample rate follows the model's last answer."""

    def __init__(self, speaker: str = "vivian", language: str = "English", instruct: str = "", model_size: str = "0.6b", model=None, sample_rate: int = RATE):
        if model is None:
            from qwen_tts import Qwen3TTSModel  # not installed everywhere; a model can be given instead

            model = Qwen3TTSModel.from_pretrained(VOICE_MODELS.get(model_size.lower(), VOICE_MODELS["0.6b"]))
        self.model, self.speaker, self.language, self.instruct, self.sample_rate = model, speaker, language, instruct, sample_rate

    def generate(self, text: str) -> np.ndarray:
        audio, self.sample_rate = self.model.generate_custom_voice(text=text, speaker=self.speaker, language=self.language, instruct=self.instruct)
        return np.asarray(audio[0] if isinstance(audio, list) else audio, dtype=np.float32)


def pcm(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


def wav_header(n_bytes: int, rate: int) -> bytes:
    """Head of a file with so many bytes of mono 16-bit samples; sizes over 32 bits are written as the largest, as players
    expect of streams."""
    n_bytes = min(n_bytes, 2**32 - 1 - 36)
    return b"RIFF" + struct.pack("<I", 36 + n_bytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", n_bytes)


def segments(paragraphs: DataFrame) -> DataFrame:
    """One row for each piece of a paragraph that an engine is given: key, para_no, segment_no, text."""
    return paragraphs.select("doc_id", "section_no", "para_no", F.posexplode(T.speech_segments(F.col("text"))).alias("segment_no", "text"))


def synthesised(paragraphs: DataFrame, engine: Callable[[], Engine]) -> DataFrame:
    """key, para_no, sample_rate and pcm of each paragraph. The engine is made once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for pdf in batches:
            sound = [pcm(own.generate(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "section_no": pdf["section_no"], "para_no": pdf["para_no"], "sample_rate": own.sample_rate, "pcm": sound})

    return paragraphs.select("doc_id", "section_no", "para_no", "text").mapInPandas(run, "doc_id bigint, section_no int, para_no int, sample_rate int, pcm binary")


def in_order(audio: DataFrame) -> DataFrame:
    """doc_id, part, sample_rate, pcm: the paragraphs of a document as numbered parts of its audio. Parts are never joined
    in a row: an hour is 170 MB and a book is over what a row may hold. Sinks write them one after the other."""
    order = W.partitionBy("doc_id").orderBy("section_no", "para_no")
    return audio.withColumn("part", F.row_number().over(order)).select("doc_id", "part", "sample_rate", "pcm")


def lengths(parts: DataFrame) -> DataFrame:
    """doc_id, sample_rate and pcm_bytes of each document."""
    return parts.groupBy("doc_id").agg(F.max("sample_rate").alias("sample_rate"), F.sum(F.octet_length("pcm").cast("bigint")).alias("pcm_bytes"))
