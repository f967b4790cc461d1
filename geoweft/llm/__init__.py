"""Operators for preparing training data: filters, deduplication, decontamination, sharding,
language and quality models, tokenisation, secret scans and chat formatting."""
from pyspark import cloudpickle

from . import arrow, bpe, chat, decontaminate, fill_in_middle, language, licenses, near_dedup, quality, url_filter, whitening, words

# What tasks run travels with the job, so the executors need no install.
for _module in (arrow, bpe, chat, decontaminate, fill_in_middle, language, licenses, near_dedup, quality, url_filter, whitening, words):
    cloudpickle.register_pickle_by_value(_module)
