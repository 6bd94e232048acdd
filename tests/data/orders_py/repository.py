from abc import ABC, abstractmethod
from models import Order


class IOrderRepository(ABC):
    @abstractmethod
    def find_by_id(self, order_id): ...

    @abstractmethod
    def save(self, order): ...


class OrderRepository(IOrderRepository):
    def __init__(self):
        self._rows = {}

    def find_by_id(self, order_id):
        return self._rows.get(order_id)

    def save(self, order):
        self._rows[order.order_id] = order
