"""Stateful operators over keyed event streams."""
