"""Training-data operators: quality, language, tokenising, sharding, packing, archives and near-duplicates.

Nothing outside this folder imports it (``__spark_entry__`` adds its queries when the folder is there).
"""
