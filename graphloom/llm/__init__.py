"""Training-data operators: deduplication, filtering, decontamination, token output and packing.

Every public operator takes DataFrames and returns a DataFrame.  Shared conventions:

* Input columns are picked by name first, so extra columns (whatever they are called) never reach the plan.
* A NULL text means "no text": it matches nothing, contains nothing and is never packed.
* Rows with a NULL ``doc_id`` cannot be reported and are left out of result tables; filters keep such rows.
* An empty input gives an empty result with the same schema.
"""
