from models import Order, OrderItem, Product
from repository import IOrderRepository


class OrderService:
    def __init__(self, repository: IOrderRepository):
        self.repository = repository

    def create_order(self, order_id, product: Product, qty):
        order = Order(order_id, [OrderItem(product, qty)])
        self.repository.save(order)
        return order

    def confirm_order(self, order_id):
        order = self.repository.find_by_id(order_id)
        order.confirm()
        self.repository.save(order)
