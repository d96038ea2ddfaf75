"""Layer compositions: silver, ML features, gold and the end-to-end run."""
