"""Column functions: normalisation, similarity, morphology, difficulty scale."""
