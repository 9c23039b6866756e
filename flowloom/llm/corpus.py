"""What the tables of documents mean: sites, the tree of the mixture and its weights, and vocabularies by name."""

from __future__ import annotations

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A document's site: its source, and within it the language section (SQL expressions).
HOST, PATH = "source", "concat_ws('/', source, lang)"
#: The tree of the mixture. Sources number from 0; of three, the second is taken for a reference work, the others for the web.
DOMAIN = "CASE WHEN coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 0) % 3 = 1 THEN 'reference' ELSE 'web' END"
LEVELS = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS = {"domain": {"web": 3, "reference": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 4}}
