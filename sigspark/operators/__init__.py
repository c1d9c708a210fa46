"""Operators on long frames: alterations (sample, feature[, value]), expression (sample, gene, count), signatures (alt, gene, log2fc).

Every operator is a function from DataFrames to a DataFrame. An absent cell is 0; the samples and genes that exist are
frames of their own where means must run over all of them.
"""
