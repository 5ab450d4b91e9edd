"""Training-data operators: encoding, search, packing, filtering and near-duplicate removal."""
