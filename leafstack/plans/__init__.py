"""Question planning, prompts, providers and the engine that ties the operators together."""
