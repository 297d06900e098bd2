"""Training-data operators: quality, language-model and toxicity scores, token counts,
packing, sanitisation, duplicate removal and benchmark decontamination.

Nothing outside this folder imports it.  ``queries.register_all`` hands the
``opN_*`` queries to the driver's entry file.
"""
