"""Configuration, built-in presets and renderers: what is decided on the driver before a plan runs."""
