"""Where frames come from: event adapters, files, contracts and generators."""
