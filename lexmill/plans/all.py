"""All query modules; importing this registers them."""

from . import answers, audit, checks, discourse, forms, graph, jobs, lexicon, morphology, prompts, similarity, text, transcripts, verification  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
