"""Multi-step plans: the inference pulse, the fact store, question answering."""
